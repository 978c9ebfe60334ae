"""Row-set operators: latest wins, overlays, reconciliation, ordered unions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx


def latest_wins(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Last row per key by journal position, with the position the key first appeared at.

    max_by combines on the map side, so a key written very often costs one partial row per task.
    """
    body = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(body, position).alias("_r"), F.min(position).alias("first_position")).select(
        *keys, "_r.*", "first_position")


def prefer_ok(rows: DataFrame, keys: Sequence[str], ok: Column, position: str) -> DataFrame:
    """One row per key: the last valid one, else the last of all."""
    body = F.struct(*[c for c in rows.columns if c not in keys])
    rank = F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.col(position).alias("p"))
    return rows.groupBy(*keys).agg(F.max_by(body, rank).alias("_r")).select(*keys, "_r.*")


def overlay(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace existing ones of the same key; the rest stay."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def failed_cleanup(rows: DataFrame, predictions: DataFrame, position: str):
    """Latest rows split into keep / rerun, and the predictions that stay.

    rows: sample_id, system, error, pred_answer, incomplete_build, position; predictions: sample_id, system, hypothesis, position
    """
    keys = ["sample_id", "system"]
    blank = tx.strip(tx.text_of("pred_answer")) == ""
    failed = tx.strip(tx.text_of("error")) != ""
    late = latest_wins(rows, keys, position).withColumn("reason", F.when(failed, "error").when(blank, "empty").when(
        F.col("incomplete_build"), "incomplete_build"))
    hyp = tx.strip(tx.text_of("hypothesis"))
    preds = latest_wins(predictions, keys, position)
    bad_pred = preds.where(hyp.isin("", "[SYSTEM_ERROR]")).select(*keys)
    gone = late.where("reason is not null").select(*keys).unionByName(bad_pred).distinct()
    return late, preds.join(gone, keys, "left_anti")


def cleanup_counts(late: DataFrame) -> DataFrame:
    """Rows kept and removed per system; the reasons may overlap, as they do in the journal."""
    err, empty = tx.strip(tx.text_of("error")) != "", tx.strip(tx.text_of("pred_answer")) == ""
    return late.groupBy("system").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("reason").isNull()).alias("kept_rows"), F.count("reason").alias("removed_rows"),
        F.count_if(err).alias("removed_error_rows"), F.count_if(empty).alias("removed_empty_rows"),
        F.count_if("incomplete_build").alias("removed_incomplete_build_rows"))


def ordered_union(parts: Sequence[DataFrame], keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Distinct values per key over the parts; the first occurrence (part, order) decides the place."""
    rows = None
    for i, p in enumerate(parts):
        p = p.select(*keys, value, F.struct(F.lit(i).alias("part"), *order).alias("_o"))
        rows = p if rows is None else rows.unionByName(p)
    first = rows.groupBy(*keys, value).agg(F.min("_o").alias("_o"))
    return first


def first_match(ranked: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    return ranked.groupBy(*keys).agg(F.min(rank).alias("first_rank"))


def failure_sample(rows: DataFrame, key: str = "system", failures: int = 40, successes: int = 15) -> DataFrame:
    """Failures first, then successes, each capped per group as the report defines."""
    ok = F.coalesce("answer_correct", F.lit(False))
    r = rows.withColumn("ok", ok).withColumn("rn", F.row_number().over(W.partitionBy(key, "ok").orderBy("position")))
    return r.where(F.when(F.col("ok"), F.col("rn") <= successes).otherwise(F.col("rn") <= failures))


def pool_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per first key: members only in one of the two pools (none = the same pool)."""
    left = a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("only_left"))
    right = b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("only_right"))
    return left.unionByName(right).groupBy(keys[0], "side").agg(F.count(F.lit(1)).alias("n"))


def job_dedup(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct jobs to run; join their verdicts back on the same keys."""
    return jobs.select(*keys).distinct()


def session_sequence(turns: DataFrame) -> DataFrame:
    """Number of a session in its conversation by first appearance (sessions, not turns, are ranked)."""
    first = turns.groupBy("conversation_id", "session_id").agg(F.min("pos").alias("first_pos"))
    return first.withColumn("seq", F.row_number().over(W.partitionBy("conversation_id").orderBy("first_pos")).cast("bigint"))
