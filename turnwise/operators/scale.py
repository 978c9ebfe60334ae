"""Plan-shape helpers that keep operators safe when one key holds much of the data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Largest optimizer size estimate (bytes) that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: What is exploded from a frame (terms of texts) may be this much larger than the frame's own estimate.
FAN_OUT = 16
#: Copies of the smaller side in a salted join.
SALTS = 8


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate for the optimized plan (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def keyed_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: str,
               how: str = "inner", size_of: DataFrame | None = None) -> DataFrame:
    """Equi-join that survives hot keys on the big side.

    The small side is broadcast when its checked size allows; where it was exploded from `size_of`, a growth that the
    optimizer does not see, that frame must be smaller by `FAN_OUT`. Beyond that the big
    side is salted by the `spread` column and the small side is copied per salt,
    so a key holding a third of all rows lands on `SALTS` tasks, not one. Copies that would outweigh the big side are
    not made: the sides are joined as they are, and adaptive execution splits the partitions of a hot key.
    """
    if fits_broadcast(small) if size_of is None else fits_broadcast(size_of, BROADCAST_BYTES // FAN_OUT):
        return big.join(F.broadcast(small), list(on), how)
    if estimated_bytes(small) * SALTS > estimated_bytes(big):
        return big.join(small, list(on), how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None,
          rank: str = "rank") -> DataFrame:
    """row_number per key; with `k` the plan keeps k rows per key before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
            out: str = "rn") -> DataFrame:
    """Row number per key without sorting a whole key in one task.

    `block` must be monotone in `order` (a position divided by a constant, a day, …).
    Rows are numbered inside (key, block); a prefix sum over the block counts — one
    row per block — supplies the offset.
    """
    keys = list(keys)
    rows = df.withColumn("_b", block)
    local = rows.withColumn(
        "_l", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(before.select(*keys, "_b", "_off"), [*keys, "_b"])
    return joined.withColumn(out, (F.col("_l") + F.col("_off")).cast("bigint")).drop("_b", "_l", "_off")


def step_value(df: DataFrame, keys: Sequence[str], rn: str, cols: dict[str, str], step: int) -> DataFrame:
    """lag/lead by position as an equi-join on (key, rn + step): no per-key window.

    Hashing on the position too spreads a hot key over every task.
    """
    other = df.select(*keys, (F.col(rn) - F.lit(step)).alias(rn),
                      *[F.col(c).alias(alias) for c, alias in cols.items()])
    return df.join(other, [*keys, rn], "left")
