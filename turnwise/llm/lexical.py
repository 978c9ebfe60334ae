"""Exact ranked search over a length-stratified index.

Documents are dealt to shards. Inside a shard those with an equal length normaliser m form a stratum; the postings of a
term stand by stratum and, within it, by falling tf, so everything in one (term, stratum, tf) group has the same impact,
computed once. The largest tf of each term bounds what a stratum can score for an item: strata are visited by falling
bound, and the search ends where the next bound is below the item's worst kept score. The shards' best rows are merged.

Terms are compared as 64-bit hashes. A bitmap of fixed size of the items' terms keeps other terms from being written.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .hashing import ragged

DEPTH = 50
#: Documents of a shard, items ranked together in a task.
SHARD, ITEMS = 1 << 14, 256
#: Bits of the filter of the items' terms (2 MiB), whatever the items.
FILTER_BITS = 1 << 24
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 22
SEED = 42
_SEPARATOR = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes.maketrans(_SEPARATOR + bytes(range(65, 91)), b" " * len(_SEPARATOR) + bytes(range(97, 123)))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_counts(text: str | None) -> Counter:
    """How often each term (as bytes) stands in the text."""
    raw, counts, at = (text or "").encode().translate(_FOLD), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", min(len(raw), at + PIECE))
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


def _bag(bitmap: bytes):
    """Per document its number of terms and, of those that the filter lets through, hash and count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int | None] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                size, ends, terms, tfs = [], [0], [], []
                for text in part.column(1).to_pylist():
                    counts = term_counts(text)
                    size.append(counts.total())
                    for term, tf in counts.items():
                        if (h := known.get(term, 0)) == 0:
                            h = xxhash.xxh64_intdigest(term, SEED)
                            at = h & (FILTER_BITS - 1)
                            known[term] = h = h if bitmap[at >> 3] >> (at & 7) & 1 else None
                        if h is not None:
                            terms.append(h)
                            tfs.append(tf)
                    ends.append(len(terms))
                    if len(known) > 200_000:
                        known.clear()
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.array(terms, np.uint64).view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
    return run


def term_filter(terms: DataFrame) -> bytes:
    """Bitmap of the low bits of the hashes in `terms` (term): at most FILTER_BITS bits reach the driver."""
    position = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    maps = terms.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")).collect()
    out = bytearray(FILTER_BITS // 8)
    for row in maps:
        at = (row["bucket"] - 1) * len(row["bitmap"])
        out[at:at + len(row["bitmap"])] = row["bitmap"]
    return bytes(out)


class Shard:
    """The index over one shard: documents by stratum, postings by (term, stratum, falling tf)."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, wanted: np.ndarray):
        """sizes[i] entries of terms and tfs belong to document i, whose normaliser is m[i]; other terms than `wanted` (sorted) stay out."""
        self.order = np.argsort(m, kind="stable")
        values, first, stratum = np.unique(m[self.order], return_index=True, return_inverse=True)
        self.first = np.append(first, len(m))
        place = np.empty(len(m), np.int64)
        place[self.order] = np.arange(len(m))
        doc = np.repeat(place, sizes)
        at = np.minimum(np.searchsorted(wanted, terms), max(0, len(wanted) - 1))
        ours = wanted[at] == terms if len(wanted) else np.zeros(len(terms), bool)
        term, doc, tf = at[ours], doc[ours], tfs[ours]
        by = np.lexsort((doc, -tf, stratum[doc], term))
        term, self.doc, tf = term[by], doc[by], tf[by]
        s = stratum[self.doc]
        new = np.append(True, (term[1:] != term[:-1]) | (s[1:] != s[:-1]) | (tf[1:] != tf[:-1]))[:len(term)]
        head = np.flatnonzero(new)
        self.size = np.diff(np.append(head, len(term)))
        self.head, self.stratum = head, s[head]
        #: Impact of each group.
        self.impact = (1_000_000_000 * tf[head]) // (1000 * tf[head] + 20 * values[self.stratum])
        #: The group with the largest tf of its term and stratum.
        self.top = np.append(True, (term[head][1:] != term[head][:-1]) | (self.stratum[1:] != self.stratum[:-1]))[:len(head)]
        self.term_at = np.searchsorted(term[head], np.arange(len(wanted) + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(place, score) of documents of which the `depth` best are part, ties with the last included; strata visited."""
        group, owner = ragged(self.term_at[terms], self.term_at[terms + 1] - self.term_at[terms])
        value, strata = weights[owner] * self.impact[group], self.stratum[group]
        bound = np.zeros(len(self.first) - 1, np.int64)
        head = self.top[group]
        np.add.at(bound, strata[head], value[head])
        visit = np.argsort(-bound, kind="stable")
        visit = visit[:int((bound > 0).sum())]
        scores, kept = np.zeros(len(self.order), np.int64), np.zeros(0, np.int64)
        at, step, worst = 0, 8, 1
        while at < len(visit):
            now = visit[at:at + step]
            live = now[bound[now] >= worst]
            if len(live):
                chosen = np.zeros(len(bound), bool)
                chosen[live] = True
                of = np.flatnonzero(chosen[strata])
                entry, g = ragged(self.head[group[of]], self.size[group[of]])
                np.add.at(scores, self.doc[entry], value[of][g])
                place, _ = ragged(self.first[live], self.first[live + 1] - self.first[live])
                kept = np.concatenate([kept, scores[place]])
                if len(kept) >= depth:
                    kept = np.partition(kept, len(kept) - depth)[-depth:]
                    worst = max(1, int(kept[0]))
            at, step = at + len(live), step * 2
            if len(live) < len(now):
                break
        place = np.flatnonzero(scores >= worst)
        return place, scores[place], at


def _rank(depth: int):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        if not docs.num_rows or not items.num_rows:
            return schema.empty_table()
        docs, items = docs.combine_chunks(), items.combine_chunks()
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
        count = lambda t, c: np.diff(t.column(c).combine_chunks().offsets.to_numpy()).astype(np.int64)
        asked, per_item = flat(items, "terms"), count(items, "terms")
        wanted = np.unique(asked)
        shard = Shard(docs.column("m").to_numpy(), count(docs, "terms"), flat(docs, "terms"), flat(docs, "tfs"), wanted)
        ids = docs.column("doc_id").to_pandas().to_numpy(object)[shard.order]
        absent = np.array([i is None or i != i for i in ids])
        number = np.where(absent, 0, ids).astype(np.int64)
        out, asked_at, weights, end = [], np.searchsorted(wanted, asked), flat(items, "weights"), np.cumsum(per_item)
        for item, b, n in zip(items.column("item_id").to_pylist(), end, per_item):
            place, score, _ = shard.best(asked_at[b - n:b], weights[b - n:b], depth)
            first = np.lexsort((number[place], absent[place], -score))[:depth]
            place, score = place[first], score[first]
            out.append(pa.Table.from_arrays([pa.array([item] * len(place), pa.int64()), pa.array(number[place], mask=absent[place]), pa.array(score)], schema=schema))
        return pa.concat_tables(out)
    return run


def search(docs: DataFrame, items: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The `depth` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Weights, normalisers
    and scores are those of the query's contract, in 64-bit integers. Only scores above 0 are listed; ties go by ascending
    doc_id, null last. A null, empty or term-free text is no document and no item. Rows of items that share an item_id are
    one item with the terms of all; a null item_id is an item, too. Repeated documents are ranked one by one. No documents
    or no items give no rows; other columns are ignored.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = cut_lineage(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({TERM})"), F.lit(1)))).alias("term"))
                        .select("item_id", F.xxhash64("term").alias("term")).distinct())
    bags = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _bag(term_filter(asked)), "doc_id bigint, n bigint, terms array<bigint>, tfs array<bigint>")
    bags = cut_lineage(bags.where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    total = bags.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    df = bags.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total["docs"] + 2) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighted = asked.join(df, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("t"))
    sought = cut_lineage(weighted.select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))
    shards, chunks = -(-total["docs"] // SHARD), max(1, -(-sought.count() // ITEMS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    m = F.expr(f"50 + (50 * n * {total['docs']}L) div {total['terms']}L")
    left = (bags.where("size(terms) > 0").select("doc_id", m.alias("m"), "terms", "tfs", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), each(chunks).alias("chunk")))
    right = sought.select("*", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int").alias("chunk"), each(shards).alias("shard"))
    near = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(_rank(depth), "item_id bigint, doc_id bigint, score bigint")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
            .select(F.col("item_id").cast(item_kind).alias("item_id"), "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score"))
