"""Self-join of vectors at a cosine threshold, exact, and the redundancy of a memory by it.

Equal vectors are one class with a count, so a common vector is compared once. Classes gather in the cells of the pivot
index; a class visits the cells that may hold a partner. Inside a cell the leading part of the dot product and the norms
of what is left bound the whole, and only pairs whose bound passes are multiplied out.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .blocked import SCOPE
from .pivots import pivot_cells, units, visits

#: Share of the components in the leading part; rows compared at once.
LEADING, STRIP = 4, 512


def prefix_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) with cosine of the unit rows a[i], b[j] above the threshold, and how many pairs were multiplied out.

    Components are taken by falling spread, so that the leading ones say most.
    """
    order = np.argsort(-np.square(np.concatenate([a, b])).sum(axis=0), kind="stable")
    a, b = a[:, order], b[:, order]
    cut = -(-a.shape[1] // LEADING)
    rest_a, rest_b = np.linalg.norm(a[:, cut:], axis=1), np.linalg.norm(b[:, cut:], axis=1)
    found, whole = [], 0
    for low in range(0, len(a), STRIP):
        part = a[low:low + STRIP]
        bound = part[:, :cut] @ b[:, :cut].T + rest_a[low:low + STRIP, None] * rest_b[None]
        i, j = np.nonzero(bound > threshold - 1e-9)
        whole += len(i)
        for at in range(0, len(i), 1 << 16):
            x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            near = np.einsum("ij,ij->i", part[x], b[y]) > threshold
            found.append((x[near] + low, y[near]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)]), whole


def _pairs(threshold: float):
    def run(guests: pa.Table, members: pa.Table) -> pa.Table:
        schema = pa.schema([(SCOPE, members.schema.field(SCOPE).type), ("x", pa.int64()), ("y", pa.int64())])
        if not guests.num_rows or not members.num_rows:
            return schema.empty_table()
        i, j, _ = prefix_pairs(units(guests["vec"]), units(members["vec"]), threshold)
        y, x = guests["sample_id"].to_numpy()[i], members["raw_id"].to_numpy()[j]
        once = x < y                                    # the pair is met again in the other's cell
        return pa.Table.from_arrays([pa.array([members[SCOPE][0].as_py()] * int(once.sum()), schema.field(0).type), pa.array(x[once]), pa.array(y[once])], schema=schema)
    return run


def cosine_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(scope, x, y), x < y: classes whose vectors have a cosine above the threshold. classes: scope, class (bigint), vec"""
    docs = classes.select(SCOPE, F.col("class").alias("raw_id"), "vec")
    placed, cells = pivot_cells(docs)
    guests = visits(docs.select(SCOPE, F.col("raw_id").alias("sample_id"), "vec"), cells, float(threshold))
    keys = [SCOPE, "cell", "part"]
    g = guests.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # Guests of a cell are cut into runs that meet the members one by one.
    g = g.withColumn("run", F.pmod(F.xxhash64("sample_id"), F.lit(8)).cast("int"))
    m = placed.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return g.groupBy(*keys, "run").cogroup(m.groupBy(*keys, "run")).applyInArrow(_pairs(threshold), f"{SCOPE} {placed.schema[SCOPE].dataType.simpleString()}, x bigint, y bigint")


def redundancy(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """RDR per sample where entries carry vectors: (sample_id, n, duplicates, RDR).

    entries: sample_id, text, vec. A pair is a duplicate if its normalised texts are equal or the cosine is above the
    threshold. A blank text is like none; null and zero vectors count by their text only. Pairs are counted, not listed:
    classes of equal (text, vector) carry their size.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    e = entries.select(F.col("sample_id").alias(SCOPE), tx.normalize_answer("text").alias("nt"), F.when(norm > 0, F.col("vec").cast("array<double>")).alias("vec"))
    total = e.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("n"))
    told = cut_lineage(e.where("nt <> ''").groupBy(SCOPE, "nt", "vec").agg(F.count(F.lit(1)).alias("m")))
    vectors = cut_lineage(told.where("vec IS NOT NULL").groupBy(SCOPE, "vec").agg(F.sum("m").alias("m")).withColumn("class", F.monotonically_increasing_id()))
    links = cut_lineage(cosine_links(vectors.select(SCOPE, "class", "vec"), threshold))
    named = cut_lineage(told.join(vectors.drop("m"), [SCOPE, "vec"]).select(SCOPE, "nt", "class", "m"))
    twos = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).alias("d")
    size = vectors.select("class", "m")
    linked = links.join(size.withColumnRenamed("class", "x").withColumnRenamed("m", "a"), "x").join(size.withColumnRenamed("class", "y").withColumnRenamed("m", "b"), "y")
    both = (links.join(named.select(F.col("class").alias("x"), "nt", F.col("m").alias("a")), "x")
            .join(named.select(F.col("class").alias("y"), "nt", F.col("m").alias("b")), ["y", "nt"]))
    parts = [told.groupBy(SCOPE, "nt").agg(F.sum("m").alias("m")).groupBy(SCOPE).agg(twos("m")), vectors.groupBy(SCOPE).agg(twos("m")),
             linked.groupBy(SCOPE).agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("d")),
             # counted by text and by vector
             named.groupBy(SCOPE).agg((-F.sum(F.col("m") * (F.col("m") - 1) / 2)).alias("d")), both.groupBy(SCOPE).agg((-F.sum(F.col("a") * F.col("b"))).cast("double").alias("d"))]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    out = total.join(d.groupBy(SCOPE).agg(F.sum("d").alias("d")), SCOPE, "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return out.select(F.col(SCOPE).alias("sample_id"), "n", F.coalesce("d", F.lit(0.0)).cast("bigint").alias("duplicates"),
                      F.coalesce(F.try_divide(F.coalesce("d", F.lit(0.0)), pairs), F.lit(0.0)).alias("RDR"))
