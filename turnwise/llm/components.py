"""Connected components by alternating stars; every round is joins and aggregations over tables in the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

MOST_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """(x, y), y the least neighbour-or-self of x, and the edges of x sent to it: larger neighbours, then all smaller ones.

    `edges` has x > y. One large star (larger neighbours of u go to u's least) and one small star (smaller ones go there).
    """
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
    down = large.groupBy("x").agg(F.min("y").alias("m"))
    small = large.join(down, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return small.unionByName(down.select("x", F.col("m").alias("y"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (x, y): component is the least node reachable."""
    edges = cut_lineage(links.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        edges = cut_lineage(_star(edges))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("y").alias("node")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
