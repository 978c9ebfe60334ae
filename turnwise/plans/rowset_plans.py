"""Queries for row-set operators."""
from pyspark.sql import functions as F

from ..operators import rowset as rs
from ..operators.scale import top_k
from . import bindings as b
from .registry import plan


@plan("win_rank_tiebreak", "select o_custkey as sample_id, o_orderkey as raw_id, row_number() over (partition by o_custkey order by o_orderpriority desc, o_orderkey)::bigint as rank from orders")
def _(t):
    r = top_k(t.orders.select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("raw_id"), "o_orderpriority"), ["sample_id"], [F.desc("o_orderpriority"), F.asc("raw_id")], None)
    return r.select("sample_id", "raw_id", F.col("rank").cast("bigint").alias("rank"))


@plan("win_topk", "select * from (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey)::bigint as rank from lineitem) where rank<=5")
def _(t):
    r = top_k(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 5)
    return r.withColumn("rank", F.col("rank").cast("bigint"))


@plan("win_latest_wins", f"with {b.RUN_LOG} select sample_id, system, max(position) as position, arg_max(latency, position) as latency, arg_max(pred_answer, position) as pred_answer, min(position) as first_position from run_log group by 1,2")
def _(t):
    return rs.latest_wins(b.run_log(t).select("sample_id", "system", "position", "latency", "pred_answer"), ["sample_id", "system"], "position")


@plan("win_prefer_ok", f"""with {b.RUN_LOG}, r as (select *, row_number() over (partition by sample_id, system order by (error is null) desc, position desc) rn from run_log) select sample_id, system, position, latency from r where rn=1""")
def _(t):
    return rs.prefer_ok(b.run_log(t).select("sample_id", "system", "position", "latency", "error"), ["sample_id", "system"], F.col("error").isNull(), "position").select("sample_id", "system", "position", "latency")


@plan("win_overlay", f"""with {b.RUN_LOG}, l as (select sample_id, system, max(position) p from run_log group by 1,2), n as (select sample_id, system, p+1000000 p from l where p%3=0) select sample_id, system, p as position from l anti join n using (sample_id, system) union all select * from n""")
def _(t):
    old = b.run_log(t).groupBy("sample_id", "system").agg(F.max("position").alias("position"))
    new = old.where("position % 3 = 0").withColumn("position", F.col("position") + 1000000)
    return rs.overlay(old, new, ["sample_id", "system"])


def _cleanup(t):
    r = b.run_log(t).withColumn("sample_id", F.concat_ws("-", "sample_id", F.col("tokens") % 20))
    p = r.select("sample_id", "system", "position", F.when(F.col("position") % 19 == 0, "[SYSTEM_ERROR]").otherwise(F.col("pred_answer")).alias("hypothesis"))
    return rs.failed_cleanup(r.select("sample_id", "system", "position", "error", "pred_answer", "incomplete_build"), p, "position")


@plan("win_failed_cleanup", f"""with {b.RUN_LOG}, r as (select *, sample_id||'-'||(tokens%20) sid from run_log), l as (select * from r qualify row_number() over (partition by sid, system order by position desc)=1),
 c as (select *, case when error is not null then 'error' when trim(pred_answer)='' then 'empty' when incomplete_build then 'incomplete_build' end reason, position%19=0 or trim(pred_answer)='' as badp from l)
select system, count(*)::bigint as total_rows, count(*) filter (reason is null)::bigint as kept_rows, count(reason)::bigint as removed_rows, count(error)::bigint as removed_error_rows, count(*) filter (trim(pred_answer)='')::bigint as removed_empty_rows,
 count(*) filter (incomplete_build)::bigint as removed_incomplete_build_rows, count(*) filter (reason is null and not badp)::bigint as kept_predictions from c group by 1""")
def _(t):
    late, preds = _cleanup(t)
    return rs.cleanup_counts(late).join(preds.groupBy("system").agg(F.count(F.lit(1)).alias("kept_predictions")), "system")


@plan("win_previous", f"with {b.TURNS} select raw_id, lag(raw_id) over (partition by conversation_id, session_id order by pos) as prev_raw_id, lag(speaker) over (partition by conversation_id, session_id order by pos) as prev_speaker from turns")
def _(t):
    from ..operators.corpus import previous
    return previous(b.turns(t), ["conversation_id", "session_id"], "idx", ["raw_id", "speaker"]).select("raw_id", "prev_raw_id", "prev_speaker")


@plan("win_first_match_rank", f"with {b.LANES}, {b.LANE_GOLD} select sample_id, lane, min(rank) as first_rank from lanes join lane_gold using (sample_id, raw_id) where rank<=128 group by 1,2")
def _(t):
    return rs.first_match(b.lanes(t).join(b.lane_gold(t), ["sample_id", "raw_id"]), ["sample_id", "lane"])


@plan("win_failure_sample", f"""with {b.JUDGED}, r as (select *, row_number() over (partition by system, grade order by sample_id::int) rn from judged) select system, sample_id, grade as ok, rn::bigint as rn, text as answer from r where rn <= case when grade then 15 else 40 end""")
def _(t):
    j = b.judged(t).select("system", "sample_id", F.col("grade").alias("answer_correct"), F.col("sample_id").cast("int").alias("position"), F.col("text").alias("answer"))
    return rs.failure_sample(j, failures=40, successes=15).select("system", "sample_id", "ok", F.col("rn").cast("bigint").alias("rn"), "answer")


@plan("win_session_sequence", f"with {b.TURNS} select conversation_id, session_id, min(pos) as first_pos, row_number() over (partition by conversation_id order by min(pos))::bigint as seq from turns group by 1,2")
def _(t):
    return rs.session_sequence(b.turns(t))


@plan("set_union_unique", f"""with {b.LANES}, u as (select sample_id, raw_id, 0 part, rank from lanes where lane='oldest' and rank<=128 union all select sample_id, raw_id, 1, rank from lanes where lane='newest' and rank<=128), f as (select *, row_number() over (partition by sample_id, raw_id order by part, rank) n from u)
select sample_id, raw_id, row_number() over (partition by sample_id order by part, rank)::bigint as place from f where n=1""")
def _(t):
    l = b.lanes(t)
    u = rs.ordered_union([l.where("lane = 'oldest'"), l.where("lane = 'newest'")], ["sample_id"], "raw_id", ["rank"])
    return top_k(u, ["sample_id"], [F.asc("_o")], None, "place").select("sample_id", "raw_id", F.col("place").cast("bigint").alias("place"))


@plan("set_gold_delta", f"""with {b.LANES}, {b.LANE_GOLD}, p as (select sample_id, raw_id from lanes where lane='newest' and rank<=5), gs as (select sample_id, count(*) n from lane_gold group by 1), c as (select g.sample_id, count(p.raw_id) f from lane_gold g left join p using (sample_id, raw_id) group by 1)
select sample_id, n::bigint as n_gold, f::bigint as found, (n-f)::bigint as missing, n=f as is_subset from gs join c using (sample_id)""")
def _(t):
    top = b.lanes(t, ["newest"]).where("rank <= 5").select("sample_id", "raw_id", F.lit(1).alias("hit"))
    g = b.lane_gold(t).join(top, ["sample_id", "raw_id"], "left").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("found"))
    return g.select("sample_id", "n_gold", "found", (F.col("n_gold") - F.col("found")).alias("missing"), (F.col("n_gold") == F.col("found")).alias("is_subset"))


@plan("set_pool_equal", f"""with {b.LANES}, a as (select sample_id, raw_id from lanes where lane='newest'), b as (select sample_id, raw_id from lanes where lane='oldest') select sample_id, 'only_left' as side, count(*)::bigint as n from (select * from a except all select * from b) group by 1
union all select sample_id, 'only_right', count(*)::bigint from (select * from b except all select * from a) group by 1""")
def _(t):
    l = b.lanes(t)
    return rs.pool_equal(l.where("lane = 'newest'"), l.where("lane = 'oldest'"), ["sample_id", "raw_id"])


@plan("set_dedup_exact", "select count(*)::bigint as n, l_returnflag from (select distinct l_orderkey, l_partkey, l_returnflag from lineitem) group by 2")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag").dropDuplicates(["l_orderkey", "l_partkey", "l_returnflag"])
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@plan("set_job_dedup", "select o_orderkey as sample_id, o_custkey||'/'||o_orderpriority as job, length(o_custkey||o_orderpriority)%2=0 as verdict from orders")
def _(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("sample_id"), "o_custkey", "o_orderpriority")
    run = rs.job_dedup(jobs, ["o_custkey", "o_orderpriority"]).withColumn("verdict", F.length(F.concat("o_custkey", "o_orderpriority")) % 2 == 0)
    return jobs.join(run, ["o_custkey", "o_orderpriority"]).select("sample_id", F.concat_ws("/", "o_custkey", "o_orderpriority").alias("job"), "verdict")
