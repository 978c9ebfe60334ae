"""Queries that run the journal streams over the tables to completion and return what they wrote.

Every stream is stopped after a part of its input and started again with the same folders, as after a failure.
"""
import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import journal as jn
from . import bindings as b
from .registry import plan


def _folder(t, name):
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _in_two_runs(t, rows, first, schema, run):
    """Append the rows with `first`, run, append the others, run again."""
    path = _folder(t, "journal")
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(path)
        jn.drain(run(jn.read_stream(t.spark, path, schema)))


def _run(t, rows, first, schema, build, mode, name):
    """Drive build(stream) into a table folder over two runs; returns the folder and the schema of its batches."""
    out, kept = _folder(t, name), []

    def run(src):
        df = build(src)
        kept.append(df.schema)
        return jn.start(df, out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), mode)

    _in_two_runs(t, rows, first, schema, run)
    return out, kept[0]


@plan("st_latest", f"with {b.RUN_LOG} select sample_id, system, max(position) as position, arg_max(latency, position) as latency from run_log group by 1,2")
def _(t):
    out, cols = _folder(t, "latest"), ["sample_id", "system", "position", "latency"]
    _in_two_runs(t, b.run_log(t), F.col("position") % 2 == 0, jn.JOURNAL, lambda src: jn.upsert_latest(src.select(*cols), ["sample_id", "system"], "position", out))
    return jn.LatestTable(t.spark, out, b.run_log(t).select(*cols).schema, ["sample_id", "system"], "position").read()


@plan("st_progress", f"with {b.RUN_LOG} select case when error is not null then 'failed' when trim(pred_answer)='' then 'blank' else 'done' end as status, count(*)::bigint as n from run_log group by 1")
def _(t):
    out, schema = _run(t, b.run_log(t), F.col("position") % 2 == 0, jn.JOURNAL, jn.progress, "complete", "progress")
    return jn.versioned(t.spark, out, schema, "batch")


@plan("st_resume_dedupe", "select event_id%500 as job_id, 1::bigint as n_accepted from events group by 1")
def _(t):
    jobs = t.events.select((F.col("event_id") % 500).alias("job_id"), F.col("event_id").alias("n"))
    out, schema = _run(t, jobs, F.col("n") % 3 == 0, "job_id bigint, n bigint", lambda src: jn.accept_once(src.select("job_id"), ["job_id"]), "append", "dedupe")
    return t.spark.read.schema(schema).parquet(out).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_accepted"))


@plan("st_state_update", """with e as (select event_id, user_id, event_type, floor(value/10) v, lead(floor(value/10)) over w nv, lead(event_id) over w ni from events window w as (partition by user_id, event_type order by event_id))
select event_id::varchar as assertion_id, case when ni is null then 'CURRENT' else 'SUPERSEDED' end as status, case when nv<>v then ni::varchar end as superseded_by from e where ni is null or nv<>v""")
def _(t):
    out = _folder(t, "state")
    e = t.events.select((F.col("user_id") % 7).cast("string").alias("conversation_id"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), F.col("event_id").alias("position"),
                        F.col("event_id").cast("string").alias("assertion_id"), F.floor(F.col("value") / 10).cast("string").alias("value"))
    half = e.agg(F.avg("position")).first()[0] or 0.0
    facts = "conversation_id string, subject string, relation string, position bigint, assertion_id string, value string"
    _in_two_runs(t, e, F.col("position") <= half, facts, lambda src: jn.supersede_table(src, out))
    gone = t.spark.read.schema(jn.STATE_OUT + ", batch int").parquet(out).where("status = 'SUPERSEDED'").select("assertion_id", "status", "superseded_by")
    return gone.unionByName(jn.current_facts(t.spark, out).select("assertion_id", F.lit("CURRENT").alias("status"), F.lit(None).cast("string").alias("superseded_by")))


@plan("st_windowed_rates", """select date_trunc('hour', ts)::varchar as start, event_type as system, count(*)::bigint as n, round(avg((event_id%11=0)::int),6) as error_rate, round(avg(value),6) as avg_latency from events group by 1,2""")
def _(t):
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("system"), F.col("value").alias("latency"), F.when(F.col("event_id") % 11 == 0, "x").alias("error"), "event_id")
    out = jn.RatesTable(t.spark, _folder(t, "rates"))
    # Every other event comes in a second run, when most windows are closed.
    _in_two_runs(t, e, F.col("event_id") % 2 == 0, "ts timestamp, system string, latency double, error string, event_id bigint", out.run)
    return out.rates().select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "system", "n", F.round("error_rate", 6).alias("error_rate"), F.round("avg_latency", 6).alias("avg_latency"))
