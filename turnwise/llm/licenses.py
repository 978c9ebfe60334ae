"""Fuzzy search for short licence notices.

A notice of which up to k characters may be wrong is cut into k + 1 pieces; at least one of them stands in the text
unchanged. One Aho-Corasick pass finds the pieces, each hit names a window, and the regex library's bounded-error
matching verifies the edits there and reports the span.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPANS = ("array<struct<label:string,start:bigint,end:bigint,first_word:bigint,edits:int,length:int,base:boolean,matched:string>>")


@dataclass(frozen=True)
class Notice:
    """Words in lower case, single-spaced; `edits` characters may be inserted, lost or changed. A base notice is exact."""
    label: str
    words: str
    edits: int = 0
    base: bool = False


BASE = (Notice("cc-by", "cc by", base=True), Notice("gpl", "general public license", base=True), Notice("reserved", "all rights reserved", base=True))
NOTICES = (
    Notice("apache", "licensed under the apache license", 3), Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "creative commons attribution", 2), Notice("cc-by-nc", "licensed under cc by nc", 2), Notice("gpl", "gnu general public license", 2),
    Notice("lgpl", "gnu lesser general public license", 3), Notice("mit", "released under the mit license", 2), Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("mpl", "mozilla public license", 2), Notice("reserved", "all rights reserved", 2), Notice("unlicense", "released into the public domain", 3),
)

#: Byte to byte: A-Z to lower case, what belongs to no word to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def pieces(words: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 pieces of nearly equal length."""
    cuts = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Searcher of one task."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            for offset, piece in pieces(notice.words, notice.edits):
                where.setdefault(piece, []).append((n, offset))
        for piece, at in where.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()
        self.verify = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(x.words)}){{e<={x.edits}}}(?= )") for x in notices]

    def spans(self, words: list[bytes]) -> list[dict]:
        """Matches in the words, whole words only; character positions in the text joined by single spaces."""
        text = (b" " + b" ".join(words) + b" ").decode()
        windows: dict[int, list[list[int]]] = {}
        for end, (length, at) in self.seeds.iter(text):
            for n, offset in at:
                notice = self.notices[n]
                low = end - length - offset - notice.edits
                high = end - length + 2 - offset + len(notice.words) + notice.edits
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], low), max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = []
        for n, own in windows.items():
            notice, verify = self.notices[n], self.verify[n]
            shortest = len(notice.words) - notice.edits
            # The search gives the best match of a stretch; what stands before and behind it is searched again.
            stretches = [(max(0, low), min(len(text), high)) for low, high in own]
            while stretches:
                low, high = stretches.pop()
                if high - low < shortest or not (m := verify.search(text, low, high, concurrent=False)):
                    continue
                found.append((m.start() - 1, m.end() - 1, sum(m.fuzzy_counts), n, m.group()))
                if notice.edits:
                    stretches += [(low, m.start()), (max(m.end(), m.start() + 1), high)]
                else:
                    stretches.append((m.start() + 1, high))
        found.sort()
        out, word, seen = [], 0, 0
        for start, end, edits, n, matched in found:
            word += text.count(" ", seen + 1, start + 1)
            seen = start
            notice = self.notices[n]
            out.append({"label": notice.label, "start": start, "end": end, "first_word": word, "edits": edits, "length": len(notice.words), "base": notice.base, "matched": matched})
        return out


def scan(docs: DataFrame, notices: Sequence[Notice] = BASE + NOTICES) -> DataFrame:
    """doc_id, n_words and spans of each row's whole text; `docs` has doc_id and text.

    A span has label, start and end (characters of the words joined by single spaces), first_word, edits, the notice's
    length, whether it is a base notice, and the matched text. Null and empty texts have no words and no spans; repeated
    rows are scanned each; no rows give no rows; other columns are ignored.
    """
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        spans = None
        for batch in batches:
            n_words, spans = [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or "")
                n_words.append(len(words))
                spans.append(scanner.spans(words) if words else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, SPAN_TYPE)], ["doc_id", "n_words", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, spans {SPANS}")


SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int32()),
                                ("length", pa.int32()), ("base", pa.bool_()), ("matched", pa.string())]))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row of `scan`: n_base, first_word and last_word of the base places, base_labels, labels, score.

    score is the best 1 - edits / length over all spans, 0 without any.
    """
    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    base = F.filter("spans", lambda s: s["base"])
    at = F.transform(base, lambda s: s["first_word"])
    best = F.array_max(F.transform("spans", lambda s: F.lit(1.0) - s["edits"] / s["length"]))
    return scanned.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                          labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))
