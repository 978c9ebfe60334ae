"""Hard negatives by shared candidate lists of anchor clusters.

Anchors are clustered by direction. For a cluster, a candidate's inner product with any member is at most
|member| * |candidate| * cos(max(0, angle to the centre - widest angle of a member)); candidates are sorted by that bound
once, and all members walk the list together until the next bound certifies that nothing better follows: first for the
positives, then for the negatives in each positive's window of scores. Candidates are dealt in blocks and anchors in
chunks of whole clusters, both of bounded size; a block's best rows per anchor are merged.

Scores are exact integers; only bounds are floating point, with a margin.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage

POSITIVES, NEGATIVES = 5, 10
#: Per cent of the positive's score between which a negative's lies.
LEAST, MOST = 30, 90
#: Candidates of a block, anchors of a chunk, members of a cluster that walk together.
BLOCK, CHUNK, MEMBERS = 4096, 2048, 512
#: Anchors that the centres are fitted on, and the most centres. They decide how soon a walk ends, not its result.
SAMPLE, CENTRES = 4096, 64
NONE, MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def dense(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of float64; shorter ones are filled with zeros."""
    rows = [np.frombuffer(v, "<f8") for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows; beyond 64 bits they stay at the limit."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, NONE + 1, MAX).astype(np.int64)


def units(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True, initial=0)
    v = v / np.where(top > 0, top, 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def centres_of(vectors: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Directions of clusters of the given vectors."""
    u = units(vectors)
    centres = u[::max(1, -(-len(u) // max(1, min(CENTRES, len(u) // 16))))].copy()
    for _ in range(rounds):
        nearest = (u @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, u)
        centres = np.where(np.abs(total).sum(axis=1, keepdims=True) > 0, units(total), centres)
    return centres


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 * x) per component, as float64 bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(3)
        flat = np.floor(256 * col.flatten().to_numpy(zero_copy_only=False).astype("<f8"))
        at = np.append(0, np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())],
                                         ["uid", "vec_id", "label", "vec"])


def _clustered(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(dense(batch.column(3).to_pylist(), centres.shape[1]))[:, :centres.shape[1]]
            near = (u @ centres.T).argmax(axis=1) if len(u) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cluster"])
    return run


def walk(members: np.ndarray, candidates: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(member, window, candidate, score) of rows among which are each window's k best, ties included; and rows walked.

    allowed[i, c] says whether candidate c may stand in member i's lists; window j of member i takes scores from low[i, j] to
    high[i, j] (none if low > high).
    """
    directions = units(members)
    centre = units(directions.sum(axis=0, keepdims=True))[0]
    length = np.linalg.norm(members, axis=1)
    angle = lambda u: np.arccos(np.clip(u @ centre, -1, 1))
    wide = angle(directions[length > 0]).max(initial=0)
    bound = np.linalg.norm(candidates, axis=1) * (np.cos(np.maximum(0, angle(units(candidates)) - wide)) + 1e-6)
    order = np.argsort(-bound, kind="stable")
    bound, rows = bound[order], candidates[order]
    scores = np.full((len(members), len(rows)), NONE, np.int64)
    best = np.full((len(members), low.shape[1], k), NONE, np.int64)
    at, step, walked = 0, 256, 0
    on = np.flatnonzero((low <= high).any(axis=1))
    while at < len(rows) and len(on):
        now = slice(at, at + step)
        got = products(members[on], rows[now])
        got[~allowed[np.ix_(on, order[now])]] = NONE
        scores[on, now] = got
        walked += got.size
        for j in range(low.shape[1]):
            fit = np.where((got >= low[on, j, None]) & (got <= high[on, j, None]) & (got > NONE), got, NONE)
            best[on, j] = np.partition(np.concatenate([best[on, j], fit], axis=1), -k, axis=1)[:, -k:]
        at, step = at + step, step * 2
        if at < len(rows):
            # Nothing behind this place scores more.
            most = length[on] * bound[at] + 1e-6
            done = (most[:, None] < np.maximum(best[on].min(axis=2), low[on])) | (low[on] > high[on])
            on = on[~done.all(axis=1)]
    out = []
    for j in range(low.shape[1]):
        i, c = np.nonzero((scores >= np.maximum(best[:, j].min(axis=1), low[:, j])[:, None]) & (scores <= high[:, j, None]) & (scores > NONE))
        out.append((i, np.full(len(i), j), order[c], scores[i, c]))
    return *(np.concatenate(x) for x in zip(*out)), walked


def _best(k: int, alike: bool):
    """The k best candidates of the block per (anchor, window) of the chunk, of the anchor's label or of others."""
    schema = pa.schema([("anchor_uid", pa.int64()), ("anchor_id", pa.int64()), ("within", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if not block.num_rows or not chunk.num_rows:
            return schema.empty_table()
        block, chunk = block.combine_chunks(), chunk.combine_chunks()
        label, uid, anchor_label, anchor_uid = block["label"].to_numpy(), block["uid"].to_numpy(), chunk["label"].to_numpy(), chunk["uid"].to_numpy()
        ids = block["vec_id"].fill_null(MAX).to_numpy()
        every = dense([*block["vec"].to_pylist(), *chunk["vec"].to_pylist()])
        candidates, anchors = every[:len(uid)], every[len(uid):]
        windows = chunk["windows"].to_pylist()
        cluster, part = chunk["cluster"].to_numpy(), chunk["part"].to_numpy()
        by = np.lexsort((part, cluster))
        cuts = np.flatnonzero(np.append(True, (cluster[by][1:] != cluster[by][:-1]) | (part[by][1:] != part[by][:-1])))
        out = []
        for a in np.split(by, cuts[1:]):
            width = max(len(windows[i]) for i in a)
            low, high = np.full((len(a), width), 1, np.int64), np.zeros((len(a), width), np.int64)
            for x, i in enumerate(a):
                for j, p in enumerate(windows[i]):
                    low[x, j], high[x, j] = (NONE + 1, MAX) if alike else (-(-LEAST * p // 100), MOST * p // 100)
            allowed = (anchor_label[a, None] == label[None]) & (anchor_uid[a, None] != uid[None]) if alike else anchor_label[a, None] != label[None]
            i, j, c, score, _ = walk(anchors[a], candidates, allowed, low, high, k)
            rank = np.lexsort((uid[c], ids[c], -score, j, i))
            i, j, c, score = i[rank], j[rank], c[rank], score[rank]
            head = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[:len(i)]
            first = np.arange(len(i)) - np.repeat(head, np.diff(np.append(head, len(i)))) < k
            i, j, c, score = i[first], j[first], c[first], score[first]
            at = pa.array(a[i])
            out.append(pa.Table.from_arrays([chunk["uid"].take(at), chunk["vec_id"].take(at), pa.array([windows[a[x]][y] for x, y in zip(i, j)], pa.int64()), pa.array(uid[c]),
                                             block["vec_id"].take(pa.array(c)), pa.array(score)], schema=schema))
        return pa.concat_tables(out)
    return run


def mine(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the anchors of `vectors` (vec_id, label, embedding).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a null label or vector or a
    null or non-finite component take no part. Where vec_id is divisible by 7 the label becomes (label + 1) % 10. Anchors are
    the rows whose vec_id is divisible by 100. Scores are inner products of floor(256 * x); ties go by smaller vec_id, null
    last. A shorter vector counts as filled with zeros; scores beyond 64 bits stay at the limit. Rows that share a vec_id are
    different rows: each may be an anchor, and another's positive or negative. No rows give no rows; other columns are ignored.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    rows = cut_lineage(vectors.where(sound).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), "embedding")
                       .mapInArrow(_scaled, "uid bigint, vec_id bigint, label bigint, vec binary"))
    is_anchor = F.col("vec_id") % 100 == 0
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    if not size["anchors"]:
        return vectors.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint")
    sample = rows.where(is_anchor).orderBy(F.xxhash64("uid"), "uid").select("vec").limit(SAMPLE).collect()
    placed = rows.where(is_anchor).mapInArrow(_clustered(centres_of(dense([r["vec"] for r in sample]))), "uid bigint, vec_id bigint, label bigint, vec binary, cluster int")
    # At most CENTRES rows.
    parts = placed.groupBy("cluster").agg(F.expr(f"(count(1) + {MEMBERS - 1}) div {MEMBERS}").alias("parts"))
    blocks, chunks = -(-size["rows"] // BLOCK), -(-size["anchors"] // CHUNK)
    anchors = cut_lineage(placed.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64("uid"), "parts"))
                          .withColumn("chunk", F.pmod(F.xxhash64("cluster", "part"), F.lit(chunks)).cast("int")).drop("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("*", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), each(chunks).alias("chunk")).groupBy("block", "chunk")
    found = "anchor_uid bigint, anchor_id bigint, within bigint, uid bigint, vec_id bigint, score bigint"

    def best(of: DataFrame, k: int, alike: bool) -> DataFrame:
        near = dealt.cogroup(of.select("*", each(blocks).alias("block")).groupBy("block", "chunk")).applyInArrow(_best(k, alike), found)
        order = W.partitionBy("anchor_uid", "within").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    positives = cut_lineage(best(anchors.withColumn("windows", F.array(F.lit(0).cast("bigint"))), POSITIVES, True)
                            .select("anchor_uid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # At most POSITIVES windows an anchor.
    windows = positives.groupBy(F.col("anchor_uid").alias("uid")).agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    negatives = best(anchors.join(windows, "uid"), NEGATIVES, False).select(
        F.col("anchor_uid").alias("_uid"), F.col("within").alias("_within"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(negatives, (F.col("anchor_uid") == F.col("_uid")) & (F.col("positive_score") == F.col("_within")))
    return out.select(*[F.col(c).cast(kind).alias(c) for c in ("anchor_id", "positive_id")], "rank", F.col("negative_id").cast(kind).alias("negative_id"), "positive_score", "negative_score")
