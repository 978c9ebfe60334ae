"""Blocked inverted index: the best records of every query in its scope, exact, without a row per (query, record) pair.

Texts are cut into terms once, into one row per record with its terms (as 64-bit hashes) and their counts; terms nobody
asks for are dropped before that row is written. Records and queries of a scope are dealt to blocks of bounded size. Inside
a block the postings of a term are cut into ranges of records of like length, each with its largest impact; the sum of
those over a query's terms bounds what a range can score. Ranges are visited by falling bound, and the search ends where
the bound is below the query's worst kept record. A block gives at most `depth` rows a query.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import text as tx
from ..session import cut_lineage
from .scale import keyed_join

SCOPE = "conversation_id"
#: Records and queries of a block, records of a range.
DOC_BLOCK, QUERY_BLOCK, RANGE = 4096, 512, 64
#: Bits of the filter of the asked terms (2 MiB), whatever the queries.
FILTER_BITS = 1 << 24
#: Terms counted at a time; a longer text is counted alone.
TERMS = 1 << 18
ROUND = 6
#: impact(tf, length of the record, mean length in the scope) -> what one unit of query weight scores
Impact = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1, and the i of each element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


def block_pairs(queries: DataFrame, docs: DataFrame, query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK):
    """Cuts each scope into query blocks × record blocks of bounded size and pairs the blocks.

    Records are assigned by id hash, so all rows of a record meet a query in one block.
    """
    nd = docs.groupBy(SCOPE).agg(F.ceil(F.count(F.lit(1)) / doc_block).cast("int").alias("nd"))
    nq = queries.groupBy(SCOPE).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("nq"))
    n = nd.join(nq, SCOPE)
    cut = lambda key, k: F.pmod(F.xxhash64(key), F.col(k)).cast("int")
    span = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    q = keyed_join(queries, n, [SCOPE], "sample_id", size_of=docs.select(SCOPE)).withColumn("qb", cut("sample_id", "nq")).withColumn("db", span("nd")).drop("nd", "nq")
    d = keyed_join(docs, n, [SCOPE], "raw_id", size_of=docs.select(SCOPE)).withColumn("db", cut("raw_id", "nd")).withColumn("qb", span("nq")).drop("nd", "nq")
    keys = [SCOPE, "qb", "db"]
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides may come from one table
    q, d = own(q), own(d)
    return q.groupBy(*keys).cogroup(d.groupBy(*keys))


# -- bags of terms ---------------------------------------------------------

def asked_terms(queries: DataFrame, profile: str) -> DataFrame:
    """(sample_id, scope, term, qtf): the hashed terms of each query with their counts."""
    each = queries.select("sample_id", SCOPE, F.explode(tx.tokens("query_text", profile)).alias("term"))
    return each.groupBy("sample_id", SCOPE, F.xxhash64("term").alias("term")).agg(F.count(F.lit(1)).alias("qtf"))


def term_filter(asked: DataFrame) -> bytes:
    """Bitmap of the low bits of the hashes in `asked` (term); FILTER_BITS bits reach the driver, whatever the input."""
    p = F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    maps = asked.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap")).collect()
    out = bytearray(FILTER_BITS // 8)
    for row in maps:
        at = (row["bucket"] - 1) * len(row["bitmap"])
        out[at:at + len(row["bitmap"])] = row["bitmap"]
    return bytes(out)


def _count(bitmap: bytes, every: bool = False):
    """The last column, a list of hashes, becomes dl, terms and tfs: its length and the counts of asked terms; with `every` also of all terms."""
    bits = np.frombuffer(bitmap, np.uint8)

    def lists(term: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
        by = np.lexsort((term, row))
        term, row = term[by], row[by]
        head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])))[:len(term)]
        tf = np.diff(np.append(head, len(term)))
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[head], minlength=n))).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(term[head])), pa.ListArray.from_arrays(offsets, pa.array(tf))]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + TERMS, side="right")))
                yield batch.slice(at, to - at)
                at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            col = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            low = flat & (FILTER_BITS - 1)
            ours = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            names = batch.schema.names[:-1] + ["dl", "terms", "tfs"] + ["every", "counts"] * every
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size), *lists(flat[ours], row[ours], len(size)), *(lists(flat, row, len(size)) if every else [])], names)

    return run


def record_bags(docs: DataFrame, asked: DataFrame, profile: str, keep: Sequence[str] = ()) -> DataFrame:
    """One written row per row of `docs`: scope, raw_id, doc_id, the `keep` columns, dl, terms, tfs (asked terms only)."""
    d = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.col("raw_id"))
    cols = list(dict.fromkeys([SCOPE, "raw_id", "doc_id", *keep]))
    cut = d.select(*cols, F.transform(tx.tokens("text", profile), lambda x: F.xxhash64(x)).alias("_t"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*cut.schema.fields[:-1], T.StructField("dl", T.LongType()), T.StructField("terms", longs), T.StructField("tfs", longs)])
    return cut_lineage(cut.mapInArrow(_count(term_filter(asked)), schema))


def counted_records(records: DataFrame, asked: DataFrame, profile: str) -> DataFrame:
    """One written row per record (`_texts`: its texts): its columns, dl, terms and tfs of the asked terms, every and counts of all."""
    hashed = F.flatten(F.transform("_texts", lambda x: F.transform(tx.tokens(x, profile), lambda w: F.xxhash64(w))))
    cut = records.select(*[c for c in records.columns if c != "_texts"], hashed.alias("_t"))
    longs = T.ArrayType(T.LongType())
    added = [T.StructField("dl", T.LongType())] + [T.StructField(c, longs) for c in ("terms", "tfs", "every", "counts")]
    return cut_lineage(cut.mapInArrow(_count(term_filter(asked), True), T.StructType([*cut.schema.fields[:-1], *added])))


def weighted_queries(weights: DataFrame) -> DataFrame:
    """(sample_id, scope, avg_len, terms, weights) from rows (sample_id, scope, avg_len, term, w); a list is as long as the query."""
    g = weights.groupBy("sample_id", SCOPE).agg(F.first("avg_len").alias("avg_len"), F.collect_list(F.struct("term", F.col("w").cast("double").alias("w"))).alias("t"))
    return g.select("sample_id", SCOPE, F.col("avg_len").cast("double").alias("avg_len"), F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))


# -- one block -------------------------------------------------------------

class Block:
    """Postings of a block's records by (term, range)."""

    def __init__(self, doc: np.ndarray, raw: np.ndarray, dl: np.ndarray, terms: np.ndarray, amounts: np.ndarray, wanted: np.ndarray, impact: Callable):
        """Entry e: record doc[e] holds terms[e] amounts[e] times. raw[d] and dl[d] are document d's record and length."""
        self.raw = raw
        place = np.empty(len(dl), np.int64)
        place[np.argsort(dl, kind="stable")] = np.arange(len(dl))
        self.range_of = place // RANGE
        at = np.minimum(np.searchsorted(wanted, terms), max(0, len(wanted) - 1))
        ours = np.flatnonzero(wanted[at] == terms) if len(wanted) else np.zeros(0, np.int64)
        term, doc, amounts = at[ours], doc[ours], amounts[ours]
        by = np.lexsort((doc, self.range_of[doc], term))
        term, doc, amounts = term[by], doc[by], amounts[by]
        one = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))[:len(term)]
        amounts = np.add.reduceat(amounts, one) if len(one) else amounts
        term, self.doc = term[one], doc[one]
        self.factor = impact(amounts.astype(np.float64), dl[self.doc].astype(np.float64))
        ranges = self.range_of[self.doc]
        self.run = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (ranges[1:] != ranges[:-1])))[:len(term)]
        self.run_size = np.diff(np.append(self.run, len(term)))
        self.run_range = ranges[self.run]
        self.run_most = np.maximum.reduceat(self.factor, self.run) if len(self.run) else self.factor
        self.run_at = np.searchsorted(term[self.run], np.arange(len(wanted) + 1))
        self.by_range = np.argsort(self.range_of, kind="stable")
        self.range_at = np.searchsorted(self.range_of[self.by_range], np.arange(-(-len(dl) // RANGE) + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, depth: int, least: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(document, score) among which are those of the `depth` best records, ties included; ranges visited."""
        value = np.minimum if least else np.multiply
        run, owner = ragged(self.run_at[terms], self.run_at[terms + 1] - self.run_at[terms])
        ranges = self.run_range[run]
        bound = np.bincount(ranges, weights=value(self.run_most[run], weights[owner]), minlength=len(self.range_at) - 1)
        visit = np.argsort(-bound, kind="stable")
        visit = visit[:int((bound > 0).sum())]
        bound = bound * (1 + 1e-9) + 1e-9
        scores, records = np.zeros(len(self.raw)), np.zeros(int(self.raw.max()) + 1 if len(self.raw) else 0)
        at, step, worst = 0, max(4, depth // RANGE), 0.0
        while at < len(visit):
            now = visit[at:at + step]
            live = now[bound[now] >= worst]
            if len(live):
                chosen = np.zeros(len(bound), bool)
                chosen[live] = True
                of = np.flatnonzero(chosen[ranges])
                entry, k = ragged(self.run[run[of]], self.run_size[run[of]])
                np.add.at(scores, self.doc[entry], value(self.factor[entry], weights[owner[of]][k]))
                seen, _ = ragged(self.range_at[live], self.range_at[live + 1] - self.range_at[live])
                docs = self.by_range[seen]
                np.maximum.at(records, self.raw[docs], scores[docs])
                if np.count_nonzero(records) >= depth:
                    worst = float(np.partition(records, len(records) - depth)[len(records) - depth]) - 2e-6
            at, step = at + len(live), step * 2
            if len(live) < len(now):
                break
        found = np.flatnonzero((scores > 0) & (scores >= worst))
        return found, scores[found], at


def _ranks(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Place of each row in the order of the columns, nulls first; equal rows in their own order."""
    flat = table.select(columns)
    while any(pa.types.is_struct(f.type) for f in flat.schema):
        flat = flat.flatten()
    columns = flat.schema.names
    order = pc.sort_indices(flat, sort_keys=[(c, "ascending") for c in columns], null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _search(depth: int, impact: Impact, least: bool, tie: Sequence[str], schema: pa.Schema):
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        if not queries.num_rows or not docs.num_rows:
            return schema.empty_table()
        queries, docs = queries.combine_chunks(), docs.combine_chunks()
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = lambda t: pc.list_value_length(t.column("terms").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        code = lambda c: docs.column(c).combine_chunks().dictionary_encode()
        named = code("doc_id")
        number = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Rows of one doc_id are parts of one text.
        first = np.full(len(named.dictionary), -1, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        dl = np.bincount(number, weights=docs.column("dl").to_numpy(), minlength=len(first))
        raw = code("raw_id").indices.to_numpy(zero_copy_only=False).astype(np.int64)[first]
        asked, n = flat(queries, "terms"), sizes(queries)
        wanted = np.unique(asked)
        avg = float(queries.column("avg_len")[0].as_py() or 0.0)
        block = Block(np.repeat(number, sizes(docs)), raw, dl, flat(docs, "terms"), flat(docs, "tfs"), wanted, lambda tf, length: impact(tf, length, avg))
        rank = _ranks(docs, tie)[first]
        asked_at, weights, end = np.searchsorted(wanted, asked), flat(queries, "weights"), np.cumsum(n)
        out, ids = [], queries.column("sample_id")
        for i, (b, k) in enumerate(zip(end, n)):
            doc, score, _ = block.best(asked_at[b - k:b], weights[b - k:b], depth, least)
            by = np.lexsort((rank[doc], -np.round(score, ROUND)))
            doc, score = doc[by], score[by]
            _, once = np.unique(raw[doc], return_index=True)
            once = np.sort(once)[:depth]
            rows = pa.array(first[doc[once]])
            out.append(pa.Table.from_arrays([pa.array([ids[i].as_py()] * len(once), schema.field(0).type), docs.column("raw_id").take(rows), docs.column("doc_id").take(rows), pa.array(score[once])],
                                            schema=schema))
        return pa.concat_tables(out).combine_chunks()
    return run


def top_records(queries: DataFrame, records: DataFrame, depth: int, impact: Impact, least: bool = False, tie: Sequence[str] = ("raw_id",)) -> DataFrame:
    """(sample_id, raw_id, doc_id, score): per query rows among which are the `depth` best records of its scope.

    queries as `weighted_queries`, records as `record_bags`. A document scores the sum over shared terms of weight * impact
    (with `least`: the lesser of weight and impact), a record the best of its documents. Order is score (rounded to 6
    places) descending, then `tie` columns. Records that share no term are not listed; at most `depth` rows a block.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [queries.schema["sample_id"].dataType, records.schema["raw_id"].dataType, records.schema["doc_id"].dataType]
    schema = pa.schema([(n, to_arrow_type(k)) for n, k in zip(("sample_id", "raw_id", "doc_id"), kinds)] + [("score", pa.float64())])
    text = ", ".join(f"{n} {k.simpleString()}" for n, k in zip(("sample_id", "raw_id", "doc_id"), kinds)) + ", score double"
    cols = list(dict.fromkeys([SCOPE, "raw_id", "doc_id", "dl", "terms", "tfs", *tie]))
    return block_pairs(queries, records.select(*cols)).applyInArrow(_search(depth, impact, least, tuple(tie), schema), text)
