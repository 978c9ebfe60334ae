"""Splittable reader of large JSON arrays: one row per element, whatever the size of the file.

Spark's text reader cuts a file at every `}` and so by byte ranges, through whatever store it can reach. A first pass sums
up each range: whether it changes from outside to inside a string, and what it does to the nesting depth in either case.
From those sums every range knows its state at the start. A second pass cuts elements at the commas of the array's own
depth; what a range boundary cuts apart is put together from its fragments. No value is larger than one element.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage

#: Keys under which an object may hold the array, as its first member.
WRAPPERS = ("samples", "records", "data", "items")
#: Bytes that are scanned at once.
RUN = 4 << 20
_ROWS = "file string, start bigint, value string"


class Marks:
    """Quotes, brackets and commas of a run of bytes that starts with no escape pending."""

    def __init__(self, raw: bytes):
        self.arr = np.frombuffer(raw, np.uint8)
        at = np.arange(len(self.arr))
        plain = np.maximum.accumulate(np.where(self.arr != 92, at, -1)) if len(at) else at
        quotes = np.flatnonzero(self.arr == 34)
        before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], quotes - 1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
        self.parity = np.zeros(len(self.arr), np.int8)
        self.parity[quotes] = 1
        self.parity = np.cumsum(self.parity) % 2
        step = np.zeros(256, np.int8)
        step[[91, 123]], step[[93, 125]] = 1, -1
        self.steps = step[self.arr]

    def depths(self, inside: int) -> np.ndarray:
        """Depth after each byte, from 0, if the run starts inside a string (1) or not (0)."""
        return np.cumsum(np.where(self.parity == inside, self.steps, 0))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, bytes): the rows of a range in runs of about `RUN` bytes, each row closed by its `}` again."""
    key, held, size = None, [], 0
    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (file, start) or size >= RUN:
                if held:
                    yield *key, b"".join(held)
                key, held, size = (file, start), [], 0
            raw = value.encode() + b"}"
            held.append(raw)
            size += len(raw)
    if held:
        yield *key, b"".join(held)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges: dict[tuple[str, int], list] = {}
    for file, start, raw in _runs(batches):
        marks = Marks(raw)
        own = ranges.setdefault((file, start), [raw[:80].decode(errors="ignore"), 0, 0, 0])
        turned, zero, one = own[1:]
        depth = [int(marks.depths(s)[-1]) for s in (0, 1)]
        own[1:] = [turned ^ int(marks.parity[-1]), zero + depth[turned], one + depth[turned ^ 1]]
    rows = [(f, s, *v) for (f, s), v in ranges.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                     ["file", "start", "head", "turned", "outside", "inside"])


def base_depth(head: str) -> int:
    """Depth of the elements in a file that starts like this: 1 in an array, 2 in an array under a wrapper key, else 0."""
    head = head.lstrip("﻿ \t\r\n")
    if head.startswith("["):
        return 1
    key, _, rest = head.removeprefix("{").lstrip().partition(":")
    return 2 if head.startswith("{") and key.strip().strip('"') in WRAPPERS and rest.lstrip().startswith("[") else 0


def _cut(states: dict):
    """Elements, and the fragments at the ends of a range: part is 0 for a whole, 1 for an end, 2 for a middle or a start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, base, closed, rest, first = None, 0, 0, 0, True, b"", True

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "start", "part", "value"])

        def last():
            return [(*key, 2, rest.decode())] if key is not None and not closed and rest else []

        for file, start, raw in _runs(batches):
            out = []
            if key != (file, start):
                out += last()
                key = (file, start)
                inside, depth, base = states[key]
                # A range that starts inside the array starts inside an element, or at the comma behind one.
                closed, first, rest = base == 0 or (depth < base and start > 0), start > 0, b""
                opened = depth >= base
            if not closed:
                marks = Marks(raw)
                after = depth + marks.depths(inside)
                begin = 0
                if not opened and (up := np.flatnonzero(after >= base)).size:
                    begin, opened = int(up[0]) + 1, True
                if opened:
                    outside = marks.parity == inside
                    end = np.flatnonzero((after < base) & (np.arange(len(raw)) >= begin))
                    stop = int(end[0]) if end.size else len(raw)
                    cuts = np.flatnonzero((marks.arr == 44) & outside & (after == base))
                    cuts = cuts[(cuts >= begin) & (cuts < stop)]
                    for cut in [*cuts.tolist(), *([stop] if end.size else [])]:
                        text = (rest + raw[begin:cut]).decode()
                        if text.strip() or first:
                            out.append((*key, 1 if first else 0, text))
                        rest, begin, first = b"", cut + 1, False
                    if end.size:
                        closed = True
                    else:
                        rest += raw[begin:]
                inside ^= int(marks.parity[-1])
                depth = int(after[-1])
            if out:
                yield rows(out)
        if out := last():
            yield rows(out)
    return run


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(value): the JSON text of each element of the arrays in the files at `path`.

    A file is an array, or an object whose first member is the array under one of `WRAPPERS`; other files give no rows.
    Elements are objects as a rule; a long run of elements without an object in it is read as one piece.
    """
    place = F.col("_metadata")
    rows = spark.read.text(path, lineSep="}").select(place["file_path"].alias("file"), place["file_block_start"].alias("start"), "value")
    sums = cut_lineage(rows.mapInArrow(_summed, "file string, start bigint, head string, turned int, outside bigint, inside bigint")
                       .groupBy("file", "start").agg(F.first("head").alias("head"), F.first("turned").alias("turned"), F.first("outside").alias("outside"), F.first("inside").alias("inside")))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    at = sums.withColumn("s", (F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2).cast("int"))
    at = at.withColumn("d", F.coalesce(F.sum(F.when(F.col("s") == 0, F.col("outside")).otherwise(F.col("inside"))).over(before), F.lit(0)))
    # One short row per byte range, as many as the driver plans tasks for.
    known = at.select("file", "start", "s", "d", F.first("head").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("head")).collect()
    states = {(r["file"], r["start"]): (r["s"], r["d"], base_depth(r["head"])) for r in known}
    cut = cut_lineage(rows.mapInArrow(_cut(states), "file string, start bigint, part int, value string"))
    torn = cut.where("part > 0")
    group = F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(W.partitionBy("file").orderBy("start", "part").rowsBetween(W.unboundedPreceding, -1))
    joined = torn.withColumn("g", F.coalesce(group, F.lit(0))).groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("start", "part", "value"))).alias("f"))
    whole = joined.select(F.array_join(F.transform("f", lambda x: x["value"]), "").alias("value"))
    return cut.where("part = 0").select("value").unionByName(whole).select(F.trim(F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", "")).alias("value")).where("value <> ''")
