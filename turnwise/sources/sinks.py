"""Writers and the projections that feed them."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx


def write_by(df: DataFrame, cols: Sequence[str], path: str, fmt: str = "parquet") -> None:
    """One folder per value of `cols`. No repartition: each task writes its own rows, so a hot value is many files."""
    df.write.mode("overwrite").partitionBy(*cols).format(fmt).save(path)


def union_columns(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def write_csv(dfs: Sequence[DataFrame], path: str) -> None:
    union_columns(dfs).write.mode("overwrite").option("header", True).csv(path)


def trace_rows(results: DataFrame) -> DataFrame:
    """Result rows as one JSON trace each, metrics grouped by stage."""
    have = set(results.columns)
    group = lambda *cs: F.struct(*[F.col(c) for c in cs if c in have])
    return results.select("sample_id", "system", F.to_json(F.struct(
        group("answer_correct", "token_f1", "bleu_1").alias("answer_metrics"),
        group("retrieval_hit", "retrieval_recall", "complete_evidence_recall").alias("retrieval_metrics"),
        group("prompt_hit", "prompt_gold_coverage", "injection_loss", "gold_in_prompt").alias("prompt_metrics"),
        group("post_evidence_answer_failure", "failure_type", "failure_stage").alias("post_evidence_metrics"))).alias("trace"))


def row_hash(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("row_sha", tx.content_key(**{c: F.col(c) for c in cols}))


def manifest(df: DataFrame, cols: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: row count and two sums over 60-bit slices of the row hashes.

    Sums combine on the map side, so a table of any size is fingerprinted in one pass.
    """
    h = row_hash(df, cols)
    part = lambda at: F.sum(F.conv(F.substring("row_sha", at, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    g = h.groupBy(*by) if by else h
    return g.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("a"), part(9).alias("b")).select(
        *by, F.lit(name).alias("dataset"), "rows", F.sha2(F.concat_ws("|", "rows", F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("fingerprint"))


def file_manifest(spark, path: str) -> DataFrame:
    """sha256 and size of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def close_lineage(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Counts of every way a request/response lineage can fail to close (all zero = closed).

    requests: cell_id, request; responses: cell_id, status, request_sha256, response_sha256
    """
    # ids are counted per side first, so repeated ids cannot multiply in the join
    q = requests.groupBy("cell_id").agg(F.count(F.lit(1)).alias("nq"), F.min(F.sha2("request", 256)).alias("want"))
    a = responses.groupBy("cell_id").agg(F.count(F.lit(1)).alias("na"), F.min("status").alias("status"), F.min("request_sha256").alias("got"),
                                         F.min("response_sha256").alias("resp"))
    j = q.join(a, "cell_id", "full_outer")
    both = F.col("nq").isNotNull() & F.col("na").isNotNull()
    return j.agg(F.coalesce(F.sum("nq"), F.lit(0)).alias("requests"), F.coalesce(F.sum("na"), F.lit(0)).alias("responses"),
                 F.count_if(F.col("nq") > 1).alias("duplicate_requests"), F.count_if(F.col("na").isNull()).alias("unanswered"),
                 F.count_if(F.col("nq").isNull()).alias("unrequested"), F.count_if(both & (F.col("status") != "terminal_ok")).alias("not_terminal_ok"),
                 F.count_if(both & ~F.col("got").eqNullSafe(F.col("want"))).alias("request_hash_mismatch"),
                 F.count_if(both & (F.coalesce("resp", F.lit("")) == "")).alias("response_hash_absent"))


def binding_drift(receipt: DataFrame, expected: DataFrame) -> DataFrame:
    """Bindings (name, value) whose recorded value differs from the expected one or is absent."""
    j = expected.select("name", F.col("value").alias("expected")).join(receipt.select("name", "value"), "name", "left")
    return j.where(~F.col("value").eqNullSafe(F.col("expected")))


def predictions(results: DataFrame) -> DataFrame:
    """Prediction rows; a failed run without an answer says so."""
    ans = tx.strip(tx.text_of("pred_answer"))
    hyp = F.when(ans != "", ans).when(tx.strip(tx.text_of("error")) != "", "[SYSTEM_ERROR]").otherwise("")
    return results.select("sample_id", "system", hyp.alias("hypothesis"))


def judge_queue(results: DataFrame) -> DataFrame:
    """Work items for a judge: answer, strict flag, failure fields, gold ids and evidence lines."""
    unit = lambda u: F.concat(F.lit("- "), F.coalesce(F.nullif(u["source_id"], F.lit("")), u["turn_id"], F.lit("")), F.lit(": "), tx.normalize_text(u["text"]))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return results.select(blank("system"), blank("sample_id"), blank("question_type"), blank("question"), blank("gold_answer"), blank("pred_answer"),
                          F.coalesce("answer_correct", F.lit(False)).alias("strict_correct"), F.col("token_f1").alias("answer_f1"), blank("failure_type"),
                          F.array_join("gold_memory_ids", "; ").alias("gold_memory_ids"), F.array_join(F.transform("gold_evidence_units", unit), "\n").alias("gold_evidence_text"))
