"""Longest-processing-time sharding of groups of equal texts.

LPT wants the groups sorted by size and one heap of shard loads. Groups are first counted by size class (ten significant
bits, so at most some 25,000 classes for any input, each exact to 0.1 %); the heap runs over that bounded table and
deals each class out as ranges of group numbers; numbering groups and rows is a Spark job in blocks.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.scale import ordinal
from ..session import cut_lineage

SIGNIFICANT_BITS = 10
#: Row blocks per shard when slots are numbered.
SLOT_BLOCKS = 256


def deal(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """LPT over (class, groups, mean size): largest class first, every group to the least-loaded shard.

    Returns per class the shards that get groups of it, and the last group number (from 1) of each. Many equal groups are
    dealt as the heap would deal them: all shards are first filled to a common level, the rest goes through the heap.
    """
    loads = [0.0] * shards
    out = []
    for key, count, size in sorted(classes, key=lambda c: (-c[2], c[0])):
        given = [0] * shards
        left = count
        if left > 4 * shards:
            low, high = min(loads), max(loads) + size * (left + 1)
            for _ in range(80):          # the highest level that does not need more groups than there are
                level = (low + high) / 2
                if sum(int(max(0.0, level - x) // size) for x in loads) <= left:
                    low = level
                else:
                    high = level
            for s, x in enumerate(loads):
                given[s] = int(max(0.0, low - x) // size)
            left -= sum(given)
        heap = [(loads[s] + given[s] * size, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        loads = [loads[s] + given[s] * size for s in range(shards)]
        ends, to, end = [], [], 0
        for s, n in enumerate(given):
            if n:
                end += n
                ends.append(end)
                to.append(s)
        out.append((key, ends, to))
    return out


def size_class(size):
    """`size` with all but its leading bits cleared."""
    drop = F.greatest(F.length(F.bin(size)) - F.lit(SIGNIFICANT_BITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, shard, slot, group_bytes.

    Rows with equal texts share a shard; null and empty are the same text. size is the text's UTF-8 bytes plus 8. Shard
    bytes are near equal unless one group alone exceeds a shard's part. slot numbers a shard's rows from 0 without gaps;
    repeated ids get slots of their own. No rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                                   F.sha2(text, 256).alias("_key")))
    groups = cut_lineage(rows.groupBy("_key").agg(F.sum("size").alias("group_bytes")).withColumn("_class", size_class(F.col("group_bytes"))))
    classes = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.avg("group_bytes").alias("mean")).collect()
    ranges = docs.sparkSession.createDataFrame(
        deal([(c["_class"], c["n"], c["mean"]) for c in classes], shards),
        T.StructType([T.StructField("_class", T.LongType()), T.StructField("_ends", T.ArrayType(T.LongType())), T.StructField("_to", T.ArrayType(T.IntegerType()))]))
    numbered = ordinal(groups, ["_class"], ["_key"], F.substring("_key", 1, 2), "_rn")
    placed = numbered.join(F.broadcast(ranges), "_class").select(
        "_key", "group_bytes", F.expr("element_at(_to, size(filter(_ends, e -> e < _rn)) + 1)").alias("shard"))
    out = rows.join(placed, "_key").drop("_key")
    slots = ordinal(out, ["shard"], ["doc_id", "text_crc32"], F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BLOCKS)), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"), "group_bytes")
