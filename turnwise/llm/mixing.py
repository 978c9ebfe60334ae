"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted target/size times: whole copies first, and the rest is an inclusion probability.
The cube method moves these probabilities through the null space of the constraints (words, documents) until all but two
per block are 0 or 1. Blocks of a source fly side by side; what they leave undecided flies again together, and the two
documents left at the end are landed. Only short rows (id, source, size) move.
"""
from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3.0
#: Documents per flight block.
BLOCK = 2048
#: Sources are a configured dimension: their totals, one row each, are gathered up to this many.
MAX_SOURCES = 100_000
EPS = 1e-9
#: The largest documents of a block move first, each against all others: three at a time could not make up for their words.
LARGEST = 32


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Share the sum of all sizes by weight; what exceeds `most` times a source's size is shared again among the others."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def fly(sizes: list[float], probs: list[float], seed: int) -> list[float]:
    """Flight phase: at most two probabilities stay strictly between 0 and 1; Σ p and Σ p·size do not change.

    Every step follows a vector of the null space until one more probability is 0 or 1.
    """
    rng = random.Random(seed)
    x, p = np.asarray(sizes, float), np.asarray(probs, float)
    p[(p < EPS) | (p > 1 - EPS)] = np.round(p[(p < EPS) | (p > 1 - EPS)])
    for k in np.argsort(-x, kind="stable")[:LARGEST]:
        for _ in range(8):
            free = np.flatnonzero((p > 0) & (p < 1))
            if not 0 < p[k] < 1 or len(free) < 4:
                break
            a = np.stack([np.ones(len(free)), x[free] / (x[free].max() or 1)])
            one = (free == k).astype(float)
            u = one - a.T @ np.linalg.lstsq(a @ a.T, a @ one, rcond=None)[0]
            u[np.abs(u) < 1e-12] = 0
            if not u.any():
                break
            q = p[free] + _step(p[free], u, rng) * u
            p[free] = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
    p, sizes = p.tolist(), x.tolist()
    work: list[int] = []
    for k in np.argsort(-x, kind="stable").tolist():
        if not 0 < p[k] < 1:
            continue
        work.append(k)
        if len(work) < 3:
            continue
        a, b, c = (sizes[i] for i in work)
        u = [b - c, c - a, a - b]          # the null vector of rows (1, 1, 1) and (a, b, c)
        if not any(u):
            u = [1.0, -1.0, 0.0]
        step = _step([p[i] for i in work], u, rng)
        for i, d in zip(work, u):
            p[i] += step * d
            if p[i] < EPS or p[i] > 1 - EPS:
                p[i] = float(round(p[i]))
        work = [i for i in work if 0 < p[i] < 1]
    return p


def _step(p, u, rng: random.Random) -> float:
    """Up or down along u to the first bound, drawn so that every probability keeps its mean."""
    up = min((1 - q) / d if d > 0 else q / -d for q, d in zip(p, u) if d)
    down = min(q / d if d > 0 else (1 - q) / -d for q, d in zip(p, u) if d)
    return up if rng.random() * (up + down) < down else -down


def land(sizes: list[float], probs: list[float]) -> list[float]:
    """Landing phase: round the open probabilities so that the words come nearest to their expectation, then the documents."""
    p = list(probs)
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    if open_:
        want, n = sum(p[i] * sizes[i] for i in open_), sum(p[i] for i in open_)
        pick = min(range(1 << len(open_)), key=lambda m: (abs(sum(sizes[i] for j, i in enumerate(open_) if m >> j & 1) - want), abs(m.bit_count() - n), m))
        for j, i in enumerate(open_):
            p[i] = float(pick >> j & 1)
    return p


def _flight(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        sizes = [float(x) for x in rows["size"]]
        p = fly(sizes, rows["p"].tolist(), int(key[0]) * 1_000_003 + int(key[1]))
        rows["p"] = land(sizes, p) if last else p
        return rows
    return run


def words(text: Column) -> Column:
    """Number of words of a whole text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    size is the number of words; a null or empty text has none and is taken by probability alone. Sources come in code
    point order, null last as a source of its own, with `weights` repeating. copies is how often the mix takes the row;
    taken = copies * size <= `most` * size. Repeated rows are decided one by one. The draw depends on the rows alone,
    so reruns agree. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = cut_lineage(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer before mixing")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    plan, left = [], {}
    for i, (r, aim) in enumerate(zip(totals, aims)):
        ratio = min(most, aim / r["size"]) if r["size"] else 0.0
        whole = int(ratio + EPS)
        plan.append((i, r["source"], r["size"], aim, whole, max(0.0, ratio - whole)))
        left[i] = r["n"]
    source = spark.createDataFrame(plan, "sid int, source string, source_size bigint, target double, whole int, p double")
    part = rows.join(F.broadcast(source.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    done = part.where(f"p <= {EPS}").withColumn("p", F.lit(0.0))
    still = part.where(f"p > {EPS}")
    keep = ["doc_id", "source", "size", "sid", "source_size", "target", "whole", "p"]
    decided = [done.select(*keep)]
    while left:
        blocks = {i: max(1, -(-n // block)) for i, n in left.items()}
        last = max(blocks.values()) == 1
        count = spark.createDataFrame(list(blocks.items()), "sid int, blocks int")
        split = (still.select(*keep).join(F.broadcast(count), "sid")
                 .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(len(decided))), F.col("blocks")).cast("int")).drop("blocks"))
        flown = split.groupBy("sid", "block").applyInPandas(_flight(last), split.schema)
        if last:
            decided.append(flown.select(*keep))
            break
        flown = cut_lineage(flown)
        decided.append(flown.where("p = 0 or p = 1").select(*keep))
        still = flown.where("p > 0 and p < 1")
        left = {i: 2 * n for i, n in blocks.items()}
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as `mix` takes them, all columns as they were.

    Rows that share id, source and size share their copies as evenly as whole copies allow.
    """
    taken = (mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
             .select(F.xxhash64("doc_id", "source", "size").alias("_k"), F.struct("doc_id", "source", "size").alias("_of"), "_copies", "_rows"))
    rows = docs.select(F.struct("*").alias("_row"), F.struct("doc_id", "source", words(F.col("text")).alias("size")).alias("_is"))
    rows = rows.withColumn("_h", F.xxhash64("_is.doc_id", "_is.source", "_is.size"))
    joined = rows.join(taken, (F.col("_h") == F.col("_k")) & F.col("_is").eqNullSafe(F.col("_of")))
    number = F.row_number().over(W.partitionBy("_h", "_is").orderBy(F.xxhash64("_row.text")))
    copies = F.floor(F.col("_copies") / F.col("_rows")) + F.when(number <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    return joined.select("_row", copies.cast("int").alias("_n")).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
