"""Greedy packing: each unit joins the open chunk unless its running cost would pass the budget.

A chunk's start depends on the previous chunk's end, so the order of a group is cut into
bounded runs, each summed up by what it does to the load it is entered with.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx


def split_oversize(clauses: DataFrame, budget: int) -> DataFrame:
    """Clauses over the budget as paragraph → sentence → word parts with the parent's id; others unchanged.

    clauses: raw_id, clause_id, text. Only rows over the budget reach Python.
    """
    import re
    sentence = re.compile(r'(?<=[.!?。！？])(?=\s+[A-Z0-9"“(]|$)')

    def parts_of(text: str, room: int) -> list[str]:
        out: list[str] = []
        for para in filter(None, (p.strip() for p in text.split("\n\n"))):
            held = ""
            for s in filter(None, (x.strip() for x in sentence.split(para))):
                if held and len(held) + 1 + len(s) <= room:
                    held = f"{held} {s}"
                    continue
                if held:
                    out.append(held)
                while len(s) > room:
                    at = s.rfind(" ", 0, room)
                    at = at if at >= max(200, room // 2) else room
                    out.append(s[:at].rstrip())
                    s = s[at:].lstrip()
                held = s
            if held:
                out.append(held)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.raw_id, f"{r.clause_id}::part{j}", part, r.clause_id) for r in pdf.itertuples()
                    for j, part in enumerate(parts_of(r.text, r.room), 1)]
            yield pd.DataFrame(rows, columns=["raw_id", "clause_id", "text", "parent_clause_id"])

    room = F.greatest(F.lit(1000), F.lit(budget) - F.length("clause_id") - 64)
    c = clauses.select("raw_id", "clause_id", tx.text_of("text").alias("text"), room.cast("int").alias("room"))
    big = c.where(F.length("text") > F.col("room")).mapInPandas(run, "raw_id string, clause_id string, text string, parent_clause_id string")
    return c.where(F.length("text") <= F.col("room")).select("raw_id", "clause_id", "text", F.lit(None).cast("string").alias("parent_clause_id")).unionByName(big)


def run_outcomes(costs: Sequence[int], budget: int):
    """What packing a run leaves behind, for every load it can be entered with.

    Returns (outcome when entered empty, list of (least load, load after, chunks opened)); opened is -1
    where the whole run joins the open chunk. Starting points soon share their last chunk, so the
    list is short.
    """
    n = len(costs)
    prefix = list(accumulate(costs))
    before = [0, *prefix]
    filled = [0] * n                          # first position from i on with a positive cost
    nxt = n
    for i in range(n - 1, -1, -1):
        nxt = i if costs[i] > 0 else nxt
        filled[i] = nxt
    after: list[tuple[int, int]] = [(0, 0)] * n    # outcome of a chunk that starts at i
    for i in range(n - 1, -1, -1):
        j = max(bisect_right(prefix, before[i] + budget), filled[i] + 1)
        after[i] = (prefix[-1] - before[i], 0) if j >= n else (after[j][0], after[j][1] + 1)
    steps: list[tuple[int, int, int]] = []
    if budget - prefix[-1] >= 1:
        steps.append((1, 0, -1))
    for i in range(n - 1, -1, -1):            # loads that first overflow at i
        least, most = max(budget - prefix[i] + 1, 1), budget - before[i]
        if i > 0 and most < least:
            continue
        out = (after[i][0], after[i][1] + 1)
        if not steps or steps[-1][1:] != out:
            steps.append((least, *out))
    return after[0], steps


def enter_run(load: int, empty, steps, total: int) -> tuple[int, int]:
    """Load and chunks opened after a run entered with `load`."""
    if load == 0:
        return empty
    at = bisect_right([s[0] for s in steps], load) - 1
    _, out, opened = steps[at]
    return (load + total, 0) if opened < 0 else (out, opened)


def pack(rows: DataFrame, keys: Sequence[str], order: str, cost: Column, budget: int, run: int = 4096, out: str = "chunk") -> DataFrame:
    """Chunk numbers of a greedy pack in order, per key.

    A new chunk opens when the open one is not empty and the cost would pass the budget. A long key is
    walked in runs of `run` positions: each run is summed up by what it leaves behind, the summaries are
    chained, and the runs are then numbered side by side. No task holds more than one run of rows, or
    one short summary per run.

    `order` is an integer position, `cost` a non-negative integer.
    """
    keys = list(keys)
    r = rows.withColumn("_c", cost.cast("long")).withColumn("_o", F.col(order).cast("long")).withColumn("_run", F.floor(F.col("_o") / run).cast("long"))
    cols = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    # sorted partitions are streamed, so neither a group nor a partition is held in memory
    def stream(batches, cols_):
        for pdf in batches:
            yield pdf, zip(*(pdf[c].tolist() for c in cols_))

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "_run", "total", "empty", "steps"]
        at, costs = None, []

        def close():
            empty, steps = run_outcomes(costs, budget)
            return (*at, sum(costs), list(empty), [x for s in steps for x in s])

        for _, rows_ in stream(batches, [*keys, "_run", "_c"]):
            done = []
            for *where, c in rows_:
                if where != at:
                    if at is not None:
                        done.append(close())
                    at, costs = where, []
                costs.append(c)
            if done:
                yield pd.DataFrame(done, columns=names)
        if at is not None:
            yield pd.DataFrame([close()], columns=names)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, load, opened = None, 0, 0
        for pdf, rows_ in stream(batches, [*keys, "total", "empty", "steps"]):
            got = []
            for *where, total, empty, flat in rows_:
                if where != at:
                    at, load, opened = where, 0, 0
                got.append((load, opened))
                steps = [tuple(int(x) for x in flat[i:i + 3]) for i in range(0, len(flat), 3)]
                load, more = enter_run(load, tuple(int(x) for x in empty), steps, int(total))
                opened += more
            yield pdf[[*keys, "_run"]].assign(_load=[g[0] for g in got], _opened=[g[1] for g in got])

    by_run = [*keys, "_run"]
    laid = r.select(*by_run, "_o", "_c").repartition(*by_run).sortWithinPartitions(*by_run, "_o")
    maps = laid.mapInPandas(summarize, f"{cols}, _run long, total long, empty array<long>, steps array<long>")
    entry = maps.repartition(*keys).sortWithinPartitions(*by_run).mapInPandas(chain, f"{cols}, _run long, _load long, _opened long")
    # What a run is entered with goes ahead of its rows. A join in place of the union would already be dealt by run, so the planner
    # would drop the repartition, and could then read the join's sides unevenly and tear runs apart.
    full = r.unionByName(entry, allowMissingColumns=True).repartition(*by_run).sortWithinPartitions(*by_run, F.col("_load").isNull(), "_o")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, n = 0, 0
        for batch in batches:
            marks = []
            for c, entered, opened in zip(*(batch.column(x).to_pylist() for x in ("_c", "_load", "_opened"))):
                if entered is not None:
                    load, n = entered, opened
                    continue
                if load > 0 and load + c > budget:
                    n, load = n + 1, 0
                load += c
                marks.append(n)
            kept = batch.filter(pc.is_null(batch.column("_load"))).select(rows_named)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(marks, pa.int64())], [*rows_named, out])

    rows_named = rows.columns
    return full.mapInArrow(number, schema)


def paginate(turns: DataFrame, budget: int = 350) -> DataFrame:
    """Pages of turns by running word count."""
    return pack(turns, ["conversation_id"], "pos", tx.token_estimate("text"), budget, out="page")


def line_chunks(turns: DataFrame, budget: int = 4096) -> DataFrame:
    return pack(turns, ["conversation_id"], "pos", tx.token_estimate("text"), budget)


def clause_chunks(clauses: DataFrame, budget: int = 6000, order: str = "pos", run: int = 4096) -> DataFrame:
    """Clauses by characters plus 32 each, never across a session."""
    return pack(clauses, ["conversation_id", "session_id"], order, F.length("text") + F.length("clause_id") + 32, budget, run)
