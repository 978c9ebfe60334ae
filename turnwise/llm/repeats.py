"""Removal of byte strings that occur more than once, by suffixes sorted with prefix hashes.

1. Anchors. Of the grams in a `window`-byte string the one with the least hash is its anchor. Equal strings have equal
   anchors at equal offsets, so a corpus is described by runs of string starts with one anchor, about one per 150 bytes.
2. Counting. An anchor gram that occurs once ends the matter for its run. A run whose whole context (all bytes of its
   strings) occurs again is repeated throughout. Both are aggregations over short rows.
3. Suffix sort. What is left, mostly the edges of copied passages, is sent with its bytes to the task of its anchor.
   There suffixes are sorted by a mergesort whose comparisons find the common extension of two suffixes by binary search
   over prefix hashes; neighbours with a common extension of a whole window are compared byte by byte and marked.
   An anchor with more than `hot` different contexts is not gathered: its strings are counted by two hashes each.
4. Cutting. Marked spans are joined to the documents and removed.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .hashing import Powers, Prefix, U64, mix, ragged

WINDOW, GRAM = 400, 100
#: Different contexts of an anchor beyond which they are not gathered in one task.
HOT = 8192
#: Bytes hashed at once; a longer text is cut into pieces that overlap by a window.
PIECE = 1 << 20
#: Suffixes sorted at once.
SUFFIXES = 1 << 20


def pieces(sizes: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Loads of (row, from, to) of about `PIECE` bytes; every window of every text lies in exactly one piece."""
    load, filled = [], 0
    for row, size in enumerate(sizes):
        for low in range(0, size - window + 1, PIECE):
            high = min(size, low + PIECE + window - 1)
            load.append((row, low, high))
            filled += high - low
            if filled >= PIECE:
                yield load
                load, filled = [], 0
    if load:
        yield load


def anchor_runs(buf: np.ndarray, bounds: np.ndarray, powers: Powers, window: int, gram: int):
    """Runs of window starts with one anchor: piece, first start, last start (both in the piece), anchor offset in the
    first window, anchor hash, context hash. `bounds` has the piece ends, beginning with 0."""
    sizes = np.diff(bounds)
    rel = np.arange(len(buf)) - np.repeat(bounds[:-1], sizes)
    prefix = Prefix(buf, rel, powers)
    at = np.arange(len(buf) - gram + 1)
    grams = mix(prefix.of(at, at + gram))
    width = window - gram + 1
    low_bits = U64((1 << 22) - 1)
    key = (grams & ~low_bits) | at.astype(U64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.iinfo(U64).max, U64)
    padded[:len(key)] = key
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts, piece = ragged(bounds[:-1], np.maximum(0, sizes - window + 1))
    anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & low_bits).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, p = starts[first], starts[last], anchor[first]
    context = mix(prefix.of(s0, s1 + window) ^ mix((p - s0).astype(U64) * U64(1 << 20) + (s1 - s0).astype(U64)))
    origin = bounds[piece[first]]
    return piece[first], s0 - origin, s1 - origin, p - s0, grams[p], context


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            for load in pieces([len(t) for t in texts], window):
                buf = np.frombuffer(b"".join([texts[r][a:b] for r, a, b in load]), np.uint8)
                bounds = np.concatenate([[0], np.cumsum([b - a for _, a, b in load])])
                piece, s0, s1, inside, anchor, context = anchor_runs(buf, bounds, powers, window, gram)
                rows = np.array([r for r, _, _ in load])[piece]
                low = np.array([a for _, a, _ in load])[piece]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                    pa.array(s0 + low), pa.array((s1 - s0).astype(np.int32)), pa.array(inside.astype(np.int32))],
                    ["doc_id", "k", "anchor", "context", "start", "more", "inside"])
    return run


def _segments(window: int):
    """Bytes of the listed runs of a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("doc_id", "k", "anchor", "start", "more", "inside", "hot", "bytes")}
            for row in batch.to_pylist():
                text = row["text"].encode()
                for r in row["runs"]:
                    for name in ("anchor", "start", "more", "inside", "hot"):
                        out[name].append(r[name])
                    out["doc_id"].append(row["doc_id"])
                    out["k"].append(row["k"])
                    out["bytes"].append(text[r["start"]:r["start"] + r["more"] + window])
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))
    return run


class Suffixes:
    """Suffixes of a buffer, compared over their first `cap` bytes with logarithmically many hash comparisons."""

    def __init__(self, buf: np.ndarray, rel: np.ndarray, powers: Powers, cap: int):
        self.buf, self.prefix, self.cap = buf, Prefix(buf, rel, powers), cap

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at x and y, by binary search over prefix hashes."""
        sums, down, rel = self.prefix.sums, self.prefix.down, self.prefix.rel
        hx, hy, dx, dy = sums[x], sums[y], down[rel[x]], down[rel[y]]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.cap)
        for _ in range(self.cap.bit_length()):
            mid = (low + high + 1) >> 1
            same = (sums[x + mid] - hx) * dx == (sums[y + mid] - hy) * dy
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(low, mid - 1))
        return low

    def less(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """x before y; where the first `cap` bytes are equal, `ties`."""
        n = self.common(x, y)
        whole = n == self.cap
        n = np.minimum(n, self.cap - 1)
        return np.where(whole, ties, self.buf[x + n] < self.buf[y + n])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes `at` inside each group (equal numbers stand together); all groups merge in step."""
        at = at.copy()
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(at)))
        first, count = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(len(at)) - first
        width = 1
        while width < (size.max() if len(size) else 0):
            live = np.flatnonzero(count > width)
            x, r, base, n = at[live], place[live], first[live], count[live]
            right = (r // width) % 2 == 1
            run = r - r % (2 * width)                                 # where the pair of runs begins
            other = np.where(right, run, np.minimum(run + width, n))
            length = np.where(right, width, np.minimum(run + 2 * width, n) - other)
            low, high = np.zeros(len(x), np.int64), length.copy()
            for _ in range(width.bit_length()):                       # how many of the other run come before x
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                mid = (low[todo] + high[todo]) >> 1
                before = self.less(at[base[todo] + other[todo] + mid], x[todo], right[todo])
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
            own = np.where(right, r - run - width, r - run)
            at[base + run + own + low] = x
            width *= 2
        return at

    def repeated(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The suffixes of `at` whose first `cap` bytes another suffix of their group has too."""
        order = self.sort(at, group)
        beside = np.flatnonzero(group[1:] == group[:-1])
        x, y = order[beside], order[beside + 1]
        equal = self.common(x, y) == self.cap
        x, y = x[equal], y[equal]
        true = np.zeros(len(x), bool)
        for a in range(0, len(x), 8192):                              # hashes may collide, bytes may not
            span = np.arange(self.cap)
            true[a:a + 8192] = (self.buf[x[a:a + 8192, None] + span] == self.buf[y[a:a + 8192, None] + span]).all(axis=1)
        return np.unique(np.concatenate([x[true], y[true]]))


def repeated_spans(anchors: np.ndarray, more: np.ndarray, inside: np.ndarray, segments: list[bytes], powers: Powers, window: int):
    """(segment, from, to) in bytes of the segment, of the maximal runs of repeated windows. Rows stand ordered by anchor."""
    sizes = np.array([len(s) for s in segments])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(segments), np.uint8)
    rel = np.arange(len(buf)) - np.repeat(bounds[:-1], sizes)
    suffixes = Suffixes(buf, rel, powers, window)
    number = np.cumsum(np.append(0, anchors[1:] != anchors[:-1]))
    found = []
    # Equal windows have their anchor at the same offset, so each (anchor, offset) is sorted by itself, some offsets at a time.
    step = max(1, SUFFIXES // max(1, len(segments)))
    for low in range(0, int(inside.max()) + 1, step):
        from_ = np.maximum(0, inside - (low + step - 1))
        upto = np.minimum(more, inside - low)
        at, owner = ragged(bounds[:-1] + from_, np.maximum(0, upto - from_ + 1))
        offset = inside[owner] - (at - bounds[owner])
        key = number[owner] * (window + 1) + offset
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        if len(at):
            new = np.append(True, key[1:] != key[:-1])
            several = ~(new & np.append(new[1:], True))
            found.append(suffixes.repeated(at[several], key[several]))
    hit = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    if not len(hit):
        return hit, hit, hit
    segment = np.searchsorted(bounds, hit, side="right") - 1
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (segment[1:] != segment[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(hit)) - 1
    return segment[begin], hit[begin] - bounds[segment[begin]], hit[end] - bounds[segment[begin]] + window


def _sorted_spans(window: int):
    """Spans of partitions ordered by anchor; whole anchors are gathered until there is work for one sort."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[pa.RecordBatch] = []

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("anchor", "start", "more", "inside")}
            row, low, high = repeated_spans(col["anchor"], col["more"].astype(np.int64), col["inside"].astype(np.int64), batch.column("bytes").to_pylist(), powers, window)
            start = col["start"][row]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("k").take(pa.array(row)), pa.array(start + low), pa.array(start + high)],
                                              ["doc_id", "k", "low", "high"])

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            same = int(np.searchsorted(anchor, anchor[-1]))          # the last anchor may go on in the next batch
            if same or held and held[-1].column("anchor")[-1].as_py() != anchor[0]:
                done = held + ([batch.slice(0, same)] if same else [])
                if sum(b.num_rows for b in done) >= 512 or same:
                    yield work(joined(done))
                    held = []
            held.append(batch.slice(same))
        if held:
            yield work(joined(held))
    return run


def _window_hashes(window: int):
    """Two hashes of every window of a segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column("bytes")[row].as_py(), np.uint8)
                at = np.arange(len(raw) - window + 1)
                rel = np.arange(len(raw))
                one = Prefix(raw, rel, powers).of(at, at + window)
                two = Prefix((mix(raw.astype(U64)) & U64(0xFFFFFFFF)), rel, powers).of(at, at + window)
                many = pa.array(np.full(len(at), row))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(many), batch.column("k").take(many), pa.array(batch.column("start")[row].as_py() + at),
                                                  pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64))], ["doc_id", "k", "low", "h1", "h2"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "spans", "kept")}
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for low, high in sorted((s["low"], s["high"]) for s in spans.as_py() or []):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            kept, at = [], 0
            for low, high in merged:
                kept.append(raw[at:low])
                at = high
            kept.append(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in merged))
            out["spans"].append([{"low": a, "high": b} for a, b in merged])
            out["kept"].append(b"".join(kept))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["doc_id", *out])


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, k, low, high): byte spans of `docs` (doc_id, k, text) that are covered by strings of `window` bytes which
    start more than once anywhere. Spans may overlap and touch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = cut_lineage(docs.mapInArrow(_runs(window, gram), f"doc_id {kind}, k bigint, anchor bigint, context bigint, start bigint, more int, inside int"))
    twice = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("anchor")
    again = cut_lineage(runs.join(twice, "anchor", "left_semi"))
    row = F.struct("doc_id", "k", "start", "more", "inside")
    contexts = cut_lineage(again.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("row")))
    whole = (again.join(contexts.where("n >= 2").select("anchor", "context"), ["anchor", "context"], "left_semi")
             .select("doc_id", "k", F.col("start").alias("low"), (F.col("start") + F.col("more") + window).alias("high")))
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts >= 2")
    open_ = contexts.join(several, "anchor").select("row.*", "anchor", (F.col("contexts") > hot).alias("hot"))
    listed = open_.groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "start", "more", "inside", "hot")).alias("runs"))
    texts = docs.join(listed.withColumnsRenamed({"doc_id": "_d", "k": "_k"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k"))).select("doc_id", "k", "text", "runs")
    segments = cut_lineage(texts.mapInArrow(_segments(window), f"doc_id {kind}, k bigint, anchor bigint, start bigint, more int, inside int, hot boolean, bytes binary"))
    spans = f"doc_id {kind}, k bigint, low bigint, high bigint"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = segments.where("NOT hot").drop("hot").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_spans(window), spans)
    hashed = segments.where("hot").select("doc_id", "k", "start", "bytes").mapInArrow(_window_hashes(window), f"doc_id {kind}, k bigint, low bigint, h1 bigint, h2 bigint")
    common = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("h1", "h2")
    counted = hashed.join(common, ["h1", "h2"], "left_semi").select("doc_id", "k", "low", (F.col("low") + window).alias("high"))
    return whole.unionByName(edges).unionByName(counted)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, spans (maximal removed runs), kept (bytes).

    Every byte of a `window`-byte string that also starts elsewhere, in the same text or another, is removed, the first
    occurrence too; strings are judged on the input and never cross texts. Null and empty texts, and those shorter than
    the window, lose nothing. A row that is repeated is its own copy. No rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text, F.octet_length(text)).alias("k"), text.alias("text"))
    spans = cut_lineage(repeated(rows, window, gram, hot))
    marked = spans.groupBy("doc_id", "k").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    joined = rows.join(marked.withColumnsRenamed({"doc_id": "_d", "k": "_k"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<low:bigint,high:bigint>>, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept, and whether anything was removed, from `remove_repeats`."""
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                          (F.col("n_removed") > 0).alias("repeated"))
