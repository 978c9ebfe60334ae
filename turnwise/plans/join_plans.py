"""Queries for hydration, reconciliation and source tracing."""
from pyspark.sql import Window as W, functions as F

from ..operators import joins as jn, lanes as ln
from ..session import cut_lineage
from . import bindings as b, sqlkit as k
from .lane_plans import _TOV, raws
from .registry import plan


@plan("jn_hydrate", """select o_orderkey::varchar as sample_id, o_orderstatus as hypothesis, case when o_orderkey%4=0 then 'own question' when o_orderkey%9=0 then null else c_name end as question,
 case when o_orderkey%4=0 then null when o_orderkey%9=0 then null else c_mktsegment end as gold_answer, case when o_orderkey%4=0 or o_orderkey%9=0 then 'missing' else 'ok' end as state
 from orders join customer on c_custkey=o_custkey""")
def _(t):
    o = F.col("o_orderkey")
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    q = j.where((o % 4 != 0) & (o % 9 != 0)).select(o.cast("string").alias("sample_id"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("gold_answer"), F.lit("1").alias("question_type"))
    p = t.orders.select(o.cast("string").alias("sample_id"), F.col("o_orderstatus").alias("hypothesis"), F.when(o % 4 == 0, "own question").alias("question"))
    rows, bad = jn.hydrate(p, q)
    return rows.join(bad.select("sample_id", F.lit("missing").alias("state")), "sample_id", "left").select("sample_id", "hypothesis", "question", "gold_answer", F.coalesce("state", F.lit("ok")).alias("state"))


@plan("jn_pending_anti", f"""with {b.RUN_LOG}, r as (select sample_id||'-'||(tokens%20) as sample_id, system, error from run_log)
 select p.sample_id, s.system from (select distinct sample_id from r) p, (select distinct system from r) s where not exists (select 1 from r where r.sample_id=p.sample_id and r.system=s.system and r.error is null)""")
def _(t):
    r = b.run_log(t).select(F.concat_ws("-", "sample_id", F.col("tokens") % 20).alias("sample_id"), "system", "error")
    return jn.pending(r.select("sample_id").distinct().select("sample_id", b.each_system()), r)


@plan("jn_pending_changed", """select o_orderkey as sample_id, o_orderstatus as system, case when o_orderkey%3=0 then 'unjudged' else 'changed' end as why from orders where o_orderkey%3=0 or (o_orderkey%3=1 and o_custkey%5=0)""")
def _(t):
    sid, sys = F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("system")
    rows = t.orders.select(sid, sys, F.concat(F.lit("Part "), "o_custkey").alias("pred_answer"))
    old = F.when((F.col("o_orderkey") % 3 == 1) & (F.col("o_custkey") % 5 == 0), F.concat(F.lit("part "), F.col("o_custkey") + 1)).otherwise(F.concat(F.lit(" PART  "), "o_custkey", F.lit("!")))
    judged = t.orders.where("o_orderkey % 3 <> 0").select(sid, sys, old.alias("pred_answer"))
    return jn.pending_changed(rows, judged).select("sample_id", "system", "why")


@plan("jn_reconcile", f"""with {b.RUN_LOG}, e as (select distinct r.sample_id, s.system from run_log r, (select distinct system from run_log) s), a as (select sample_id, system, count(*) n, max(case when error is not null then 1 else 0 end) err from run_log where sample_id::int%5<>0 group by 1,2
 union all select 'ghost', system, 1, 0 from (select distinct system from run_log))
select count(e.sample_id)::bigint as expected, count(n)::bigint as actual, count(*) filter (n is null)::bigint as missing, count(*) filter (e.sample_id is null)::bigint as unexpected,
 count(*) filter (n>1)::bigint as duplicates, count(*) filter (err>0)::bigint as errors, false as valid from e full outer join a on a.sample_id=e.sample_id and a.system=e.system""")
def _(t):
    r = b.run_log(t)
    systems = r.select("system").distinct()
    expected = r.select("sample_id").distinct().select("sample_id", b.each_system())
    actual = r.where(F.col("sample_id").cast("int") % 5 != 0).select("sample_id", "system", "error").unionByName(systems.select(F.lit("ghost").alias("sample_id"), "system", F.lit(None).cast("string").alias("error")))
    return jn.reconcile(expected, actual, ["sample_id", "system"], F.col("error").isNotNull())


@plan("jn_shard_merge", """select c_custkey::varchar as raw_id, c_custkey as request_no, case when c_custkey%17=0 and c_custkey%2=0 then 'duplicate' when c_custkey%13=0 then 'missing' else 'ok' end as state from customer""")
def _(t):
    c = F.col("c_custkey")
    row = lambda df: df.select(c.cast("string").alias("raw_id"), F.col("c_name").alias("status"))
    have = t.customer.where((c % 13 != 0) | ((c % 17 == 0) & (c % 2 == 0)))
    order = t.customer.select(c.cast("string").alias("raw_id"), c.alias("request_no"))
    _, twice, missing = jn.merge_shards(order, [row(have.where(c % 2 == 0)), row(have.where((c % 2 == 1) | (c % 17 == 0)))], "raw_id")
    st = twice.select("raw_id", F.lit("duplicate").alias("state")).unionByName(missing.select("raw_id", F.lit("missing").alias("state")))
    return order.join(st, "raw_id", "left").select("raw_id", "request_no", F.coalesce("state", F.lit("ok")).alias("state"))


@plan("jn_evidence_text", f"""with {b.TURNS}, g as (select raw_id sample_id, conversation_id, case pos%3 when 0 then turn_id when 1 then session_id else 'D9:'||idx end source_id from turns),
 f as (select g.*, min(t.pos) p from g left join turns t on t.conversation_id=g.conversation_id and (t.turn_id=g.source_id or t.session_id=g.source_id) group by all)
select f.sample_id, f.conversation_id, f.source_id, coalesce({k.strip('t.text')},'') as text, coalesce(t.session_id,'') as session_id, coalesce(t.turn_id,'') as turn_id, p is not null as source_mapping_available
 from f left join turns t on t.conversation_id=f.conversation_id and t.pos=f.p""")
def _(t):
    tt = b.turns(t)
    m = F.col("pos") % 3
    g = tt.select(F.col("raw_id").alias("sample_id"), "conversation_id", F.when(m == 0, F.col("turn_id")).when(m == 1, F.col("session_id")).otherwise(F.concat(F.lit("D9:"), "idx")).alias("source_id"))
    return jn.evidence_units(g, tt)


@plan("jn_key_evidence_units", """with f as (select l_orderkey parent_id, 'f'||l_linenumber fact_id, l_linenumber ord, 'part '||l_partkey v from lineitem)
select o_orderkey::varchar as sample_id, 0 as o, 'unit '||o_custkey as unit from orders where o_orderkey%3=0
union all select o_orderkey::varchar, (ord-1)::int, v from orders join f on parent_id=o_orderkey where o_orderkey%3=1 and ord<=2
union all select o_orderkey::varchar, ord::int, v from orders join f on parent_id=o_orderkey where o_orderkey%3=2
 or (o_orderkey%3=1 and not exists (select 1 from f x where x.parent_id=o_orderkey and x.ord<=2))""")
def _(t):
    m, none = F.col("o_orderkey") % 3, F.array().cast("array<string>")
    s = t.orders.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderkey").alias("parent_id"),
                        F.when(m == 0, F.array(F.concat(F.lit(" unit "), "o_custkey"), F.lit(" "))).otherwise(none).alias("key_evidence_units"),
                        F.when(m == 1, F.array(F.lit("f1"), F.lit("f2"))).otherwise(none).alias("required_fact_ids"))
    f = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), F.concat(F.lit("f"), "l_linenumber").alias("fact_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("part "), "l_partkey").alias("value"))
    return jn.key_evidence_units(s, f)


# -- inference -------------------------------------------------------------

ENTRIES = """entries as (select assertion_id as text_id, conversation_id, raw_id, pos, ord, case when ord%4=1 then retrieval_text||' (source_ids: D1:1, D7:7; session_1)' when ord%4=2 then 'ye' else retrieval_text end as text from facts)"""


def entries(t):
    """Facts as memory texts: some cite ids, some are very short."""
    m = F.col("ord") % 4
    return b.facts(t).select(F.col("assertion_id").alias("text_id"), "conversation_id", "raw_id", "pos", "ord",
                             F.when(m == 1, F.concat("retrieval_text", F.lit(" (source_ids: D1:1, D7:7; session_1)"))).when(m == 2, F.lit("ye")).otherwise(F.col("retrieval_text")).alias("text"))


_NT, _NU = k.norm_source("e.text"), k.norm_source("t.text")
_PAIRS = f"""en as (select e.*, {_NT} nt from entries e), tn as (select t.*, {_NU} nu from turns t),
 pairs as (select e.text_id, e.conversation_id, t.pos, t.turn_id, t.session_id from en e join tn t using (conversation_id) where nt<>'' and nu<>'' and (contains(nt,nu) or contains(nu,nt)
  or len(list_intersect(list_distinct(string_split(nu,' ')), list_distinct(string_split(nt,' '))))/len(list_distinct(string_split(nu,' '))) >= 0.85))"""


@plan("jn_text_contains", f"with {b.TURNS}, {b.FACTS}, {ENTRIES}, {_PAIRS} select text_id, conversation_id, pos from pairs")
def _(t):
    return jn.text_turn_pairs(entries(t), b.turns(t)).select("text_id", "conversation_id", "pos")


_EXPL = """expl as (select text_id, conversation_id, id from (select distinct text_id, conversation_id, unnest(['D1:1','D7:7','session_1']) id from entries where ord%4=1) x
  where exists (select 1 from turns t where t.conversation_id=x.conversation_id and (t.turn_id=x.id or t.session_id=x.id)))"""


@plan("jn_explicit_ids", f"with {b.TURNS}, {b.FACTS}, {ENTRIES}, {_EXPL} select text_id, conversation_id, id as source_id from expl")
def _(t):
    return jn.explicit_ids(entries(t), b.turns(t)).select("text_id", "conversation_id", "source_id")


_OVS = f"""ew as (select text_id, conversation_id, list_distinct(regexp_extract_all(lower(text),'\\S+')) w from entries), tw as (select conversation_id, pos, turn_id, list_distinct(regexp_extract_all(lower(text),'\\S+')) w from turns),
 ov as (select e.text_id, e.conversation_id, t.turn_id, t.pos, round(len(list_intersect(e.w,t.w))/len(e.w),9) r from ew e join tw t using (conversation_id) where len(e.w)>0 and len(list_intersect(e.w,t.w))/len(e.w) > 0.15)"""


@plan("jn_overlap_sources", f"""with {b.TURNS}, {b.FACTS}, {ENTRIES}, {_OVS} select text_id, conversation_id, turn_id as source_id, rank, round(r,6) as ratio from (select *, row_number() over (partition by text_id order by r desc, pos)::bigint rank from ov) where rank<=5""")
def _(t):
    return jn.overlap_sources(entries(t), b.turns(t))


_BATCH = f"""bat as (select e.text_id, e.conversation_id, t.turn_id, t.pos, list_distinct(list_filter(string_split({_NU},' '), lambda x: x<>'')) a, list_distinct(list_filter(string_split({k.norm_source("'on '||t.timestamp||' '||e.text")},' '), lambda x: x<>'')) m, t.timestamp
   from entries e join turns s on s.raw_id=e.raw_id join turns t on t.conversation_id=e.conversation_id and t.session_id=s.session_id),
 bsc as (select *, round(case when len(a)=0 then 0 else least(1.0, 0.8*len(list_intersect(a,m))/len(a)+0.2*len(list_intersect(a,m))/len(m)+0.2) end,9) s from bat),
 bbest as (select *, max(s) over (partition by text_id) top from bsc where s>=0.34),
 brank as (select text_id, conversation_id, turn_id as source_id, round(s,6) as score, row_number() over (partition by text_id order by s desc, pos)::bigint rank from bbest where s>=round(top-0.08,9))"""


def _batch_entries(t):
    """Entries whose batch is their session; the query carries the session's date."""
    ids = b.turns(t).groupBy("conversation_id", "session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "turn_id"))), lambda x: x["turn_id"]).alias("batch_ids"))
    e = entries(t).join(b.turns(t).select("raw_id", "session_id", "timestamp"), "raw_id").join(ids, ["conversation_id", "session_id"])
    return e


@plan("jn_batch_sources", f"""with {b.TURNS}, {b.FACTS}, {ENTRIES}, {_BATCH.replace("'on '||t.timestamp||' '||e.text", "'on '||s.timestamp||' '||e.text")} select text_id, conversation_id, source_id, score, rank from brank where rank<=5""")
def _(t):
    return jn.batch_sources(_batch_entries(t).withColumn("query", F.concat(F.lit("on "), "timestamp")), b.turns(t))


@plan("jn_broad_ids", """with n as (select l_suppkey, l_orderkey, count(distinct l_partkey) d from lineitem group by 1,2), h as (select l_suppkey, count(*) n from lineitem group by 1),
 e as (select o_custkey, list(distinct o_orderkey) ids, count(*) c from orders group by 1)
select c.o_custkey::varchar as entry_id, case when len(ids) > greatest(20, floor(h.n/4)) then 0 else len(ids) end::bigint as n_ids from e c join h on h.l_suppkey = c.o_custkey%10+1""")
def _(t):
    ids = t.orders.groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("source_ids"))
    e = ids.select(F.col("o_custkey").cast("string").alias("entry_id"), (F.col("o_custkey") % 10 + 1).cast("string").alias("conversation_id"), "source_ids")
    turns = t.lineitem.select(F.col("l_suppkey").cast("string").alias("conversation_id"))
    h = turns.select("conversation_id").distinct()
    return jn.usable_ids(e.join(h, "conversation_id", "left_semi"), turns).select("entry_id", F.size("source_ids").cast("bigint").alias("n_ids"))


@plan("jn_entry_source_ids", """select o_orderkey::varchar as entry_id, case o_orderkey%4 when 0 then 'v'||o_custkey when 1 then 'm1,m2' when 2 then 'a'||o_custkey||',b' else o_orderkey::varchar end as source_ids from orders""")
def _(t):
    o, m, none = F.col("o_orderkey"), F.col("o_orderkey") % 4, F.array().cast("array<string>")
    v = F.concat(F.lit("v"), "o_custkey")
    e = t.orders.select(o.cast("string").alias("entry_id"), F.when(m == 2, F.concat(F.lit("note source_ids: a"), "o_custkey", F.lit(", b, b"))).otherwise("plain").alias("content"),
                        F.when(m == 0, F.array(v, v, F.lit(" "))).otherwise(none).alias("value_ids"), F.when(m < 2, F.array(F.lit("m1"), F.lit("m2"))).otherwise(none).alias("metadata_ids"))
    return jn.entry_source_ids(e).select("entry_id", F.array_join("source_ids", ",").alias("source_ids"))


_RETR = """retr as (select q.sample_id, q.conversation_id, row_number() over (partition by q.sample_id order by e.pos, e.ord) as rank, e.ord, e.text_id, e.text, e.raw_id, q.query_text
  from questions q join entries e on e.conversation_id=q.conversation_id and e.pos between q.pos and q.pos+1)"""


def retrieved(t):
    """Each question retrieves the facts of its own turn and of the next one, in order."""
    q = b.questions(t).select("sample_id", "conversation_id", F.col("pos").alias("qpos"), F.col("query_text").alias("query"))
    e = _batch_entries(t).withColumn("qpos", F.explode(F.array("pos", F.col("pos") - 1)))
    j = q.join(e, ["conversation_id", "qpos"])
    return j.select("sample_id", "conversation_id", F.row_number().over(W.partitionBy("sample_id").orderBy("pos", "ord")).alias("rank"), F.col("text_id").alias("entry_id"), F.col("text").alias("content"),
                    F.when(F.col("ord") == 1, F.array(F.element_at(F.split("raw_id", "::"), 2))).otherwise(F.array().cast("array<string>")).alias("source_ids"), "query", "batch_ids", "raw_id")


_OWN = "own as (select sample_id, rank, 0 p, 0 kk, 0::bigint a, 0 bb, string_split(raw_id,'::')[2] source_id from retr where ord=1)"
_SAID = f"""said as (select r.sample_id, r.rank, 1 p, 0 kk, case x.id when 'D1:1' then 0 when 'session_1' then 1 else 2 end::bigint a, 0 bb, x.id source_id from retr r join expl x on x.text_id=r.text_id
  union all select r.sample_id, r.rank, 1, 1, x.pos, 0, x.turn_id from retr r join pairs x on x.text_id=r.text_id union all select r.sample_id, r.rank, 1, 1, x.pos, 1, x.session_id from retr r join pairs x on x.text_id=r.text_id)"""
_RBATCH = f"""rb as (select r.sample_id, r.rank, t.turn_id, t.pos, list_distinct(list_filter(string_split({_NU},' '), lambda x: x<>'')) a, list_distinct(list_filter(string_split({k.norm_source("r.query_text||' '||r.text")},' '), lambda x: x<>'')) m
   from retr r join turns s on s.raw_id=r.raw_id join turns t on t.conversation_id=r.conversation_id and t.session_id=s.session_id),
 rbs as (select *, round(case when len(a)=0 or len(m)=0 then 0 else least(1.0, 0.8*len(list_intersect(a,m))/len(a)+0.2*len(list_intersect(a,m))/len(m)) end,9) s from rb),
 rbb as (select *, max(s) over (partition by sample_id, rank) top from rbs where s>=0.34),
 rbr as (select sample_id, rank, 2 p, 0 kk, row_number() over (partition by sample_id, rank order by s desc, pos)::bigint a, 0 bb, turn_id source_id from rbb where s>=round(top-0.08,9))"""


@plan("jn_trace_retrieval", f"""with {b.QUESTIONS}, {b.FACTS}, {ENTRIES}, {_PAIRS}, {_EXPL}, {_RETR}, {_OWN}, {_SAID}, {_RBATCH},
 u as (select * from own union all select * from said union all select * from rbr where a<=5),
 f as (select *, row_number() over (partition by sample_id, source_id order by rank, p, kk, a, bb) n from u)
select sample_id, source_id, row_number() over (partition by sample_id order by rank, p, kk, a, bb, source_id)::bigint as rank from f where n=1""")
def _(t):
    return jn.trace_retrieval(retrieved(t), b.turns(t))


_WHOLE = f"""wh as (select sample_id, conversation_id, string_agg(text, chr(10) order by rank) text from retr group by 1,2), wn as (select e.sample_id, e.conversation_id, {_NT} nt from wh e),
 wp as (select w.sample_id, t.pos, t.turn_id, t.session_id from wn w join tn t using (conversation_id) where nt<>'' and nu<>'' and (contains(nt,nu) or contains(nu,nt)
  or len(list_intersect(list_distinct(string_split(nu,' ')), list_distinct(string_split(nt,' '))))/len(list_distinct(string_split(nu,' '))) >= 0.85)),
 block as (select sample_id, 4611686018427387904 rank, 0 p, 1 kk, pos::bigint a, 0 bb, turn_id source_id from wp union all select sample_id, 4611686018427387904, 0, 1, pos, 1, session_id from wp)"""


@plan("jn_trace_prompt", f"""with {b.QUESTIONS}, {b.FACTS}, {ENTRIES}, {_PAIRS}, {_EXPL}, {_RETR}, {_SAID}, {_RBATCH}, {_WHOLE},
 cited as (select sample_id, rank, 0 p, 0 kk, 0::bigint a, 0 bb, case when ord=1 then string_split(raw_id,'::')[2] else text_id end source_id from retr),
 u as (select * from cited union all select * from said union all select * from rbr where a<=5 union all select * from block),
 f as (select *, row_number() over (partition by sample_id, source_id order by rank, p, kk, a, bb) n from u)
select sample_id, source_id, row_number() over (partition by sample_id order by rank, p, kk, a, bb, source_id)::bigint as rank from f where n=1""")
def _(t):
    r = cut_lineage(retrieved(t))
    p = r.select("sample_id", "conversation_id", F.col("rank").alias("place"), "entry_id")
    store = r.select("entry_id", "content", F.array().cast("array<string>").alias("source_ids")).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    block = r.groupBy("sample_id", "conversation_id").agg(F.array_join(lines, "\n").alias("text"))
    return jn.trace_prompt(p, store, r, b.turns(t), block)


@plan("jn_trace_gold", f"""with {b.QUESTIONS}, s(system) as (values ('no_memory'),('full_context'),('mem')),
 x as (select q.sample_id, s.system, lower(coalesce(g.turn_id,'')) gt, case system when 'no_memory' then '' when 'full_context' then lower(coalesce(g.turn_id,'')) else lower('D'||(q.pos//4+1)||':'||(q.pos%4+2)) end rt,
   case system when 'no_memory' then '' when 'full_context' then lower(coalesce(g.turn_id,'')) else 'd1:2' end it from questions q left join gold g using (sample_id), s)
select sample_id, system, case when gt<>'' and gt=rt then gt else '' end as retrieved_gold, case when gt<>'' and gt=it then gt else '' end as prompt_gold, case when gt<>'' and gt<>rt then gt else '' end as missing_retrieved,
 case when gt<>'' and gt<>it then gt else '' end as missing_prompt, system<>'no_memory' as source_mapping_available from x""")
def _(t):
    q = b.questions(t).join(b.gold(t).select("sample_id", "turn_id"), "sample_id", "left")
    systems = F.explode(F.array(*map(F.lit, ["no_memory", "full_context", "mem"]))).alias("system")
    ids = F.when(F.col("turn_id").isNotNull(), F.array(F.concat(F.lit(" see "), "turn_id"))).otherwise(F.array().cast("array<string>"))
    plain = F.when(F.col("turn_id").isNotNull(), F.array("turn_id")).otherwise(F.array().cast("array<string>"))
    tr = q.select("sample_id", systems, plain.alias("gold_ids"), F.array(F.concat(F.lit("turn D"), F.floor(F.col("pos") / 4) + 1, F.lit(":"), F.col("pos") % 4 + 2)).alias("retrieved_ids"),
                  F.array(F.lit("D1:2")).alias("injected_ids"), plain.alias("known_ids"))
    r = jn.trace_gold(tr)
    j = lambda c: F.array_join(c, ",")
    return r.select("sample_id", "system", j("retrieved_gold_ids").alias("retrieved_gold"), j("prompt_gold_ids").alias("prompt_gold"), j("missing_retrieved_gold_ids").alias("missing_retrieved"),
                    j("missing_prompt_gold_ids").alias("missing_prompt"), "source_mapping_available")


@plan("jn_expand_sources", f"""with {b.QUESTIONS}, {b.FACTS}, {ENTRIES}, {_RETR}, c as (select sample_id, string_split(raw_id,'::')[2] tid, min(rank) p from retr where ord=1 group by 1,2), n as (select sample_id, max(rank) n from retr group by 1)
select sample_id, rank::bigint as rank, text_id as entry_id from retr union all select sample_id, (n + row_number() over (partition by sample_id order by p))::bigint, 'source:'||tid from c join n using (sample_id)""")
def _(t):
    return jn.expand_sources(retrieved(t), b.turns(t))


@plan("jn_raw_fallback", f"""with {b.QUESTIONS}, {b.FACTS}, {ENTRIES}, {_RETR}, c as (select distinct sample_id, string_split(raw_id,'::')[2] tid from retr where ord=1), n as (select sample_id, max(rank) n from retr group by 1),
 {_TOV.format(q='questions', d='turns')}, l as (select q.sample_id, t.turn_id, t.pos, coalesce(o.score,0) s from questions q join turns t using (conversation_id) left join ot o on o.sample_id=q.sample_id and o.raw_id=t.raw_id),
 x as (select l.*, row_number() over (partition by l.sample_id order by s desc, pos) rn from l anti join c on c.sample_id=l.sample_id and c.tid=l.turn_id)
select sample_id, rank::bigint as rank, text_id as entry_id from retr union all select x.sample_id, (coalesce(n,0)+rn)::bigint, 'raw:'||turn_id from x left join n using (sample_id) where rn<=3""")
def _(t):
    lane = ln.term_overlap(b.questions(t), raws(t))
    return jn.raw_fallback(retrieved(t), lane.select("sample_id", F.element_at(F.split("raw_id", "::"), 2).alias("turn_id"), "rank"))


@plan("jn_full_context_ref", """with r as (select source as system, lang as question_type, doc_id//20 as sample_id, max(quality)::double acc from labels join documents using (doc_id) group by 1,2,3),
 r2 as (select case when system in ('src0','src1','src2','src3','src4','src5') then 'full_context' else system end system, question_type, sample_id, acc from r),
 f as (select question_type, sample_id, max(acc) fa from r2 where system='full_context' group by 1,2)
select r2.system, r2.question_type, r2.sample_id, r2.acc as "Acc", f.fa as "full_Acc" from r2 left join f using (question_type, sample_id)""")
def _(t):
    j = t.labels.join(t.documents, "doc_id")
    r = j.groupBy(F.col("source").alias("s"), F.col("lang").alias("question_type"), F.floor(F.col("doc_id") / 20).alias("sample_id")).agg(F.max("quality").cast("double").alias("Acc"))
    r = r.withColumn("system", F.when(F.col("s").isin(*[f"src{i}" for i in range(6)]), "full_context").otherwise(F.col("s"))).drop("s")
    return jn.with_full_context(r, ["question_type", "sample_id"]).select("system", "question_type", "sample_id", "Acc", "full_Acc")


@plan("jn_assert_same_scope", """with c as (select 'c'||o_custkey sample_id, 'o'||o_orderkey raw_id, o_custkey own from orders union all select 'c'||(o_custkey%50), 'o'||o_orderkey, o_custkey from orders where o_orderkey%9=0)
select sample_id, count(*)::bigint as n, count(*) filter ('c'||own<>sample_id)::bigint as foreign_n, (count(*)-count(distinct raw_id))::bigint as repeats, count(*) filter ('c'||own<>sample_id)=0 and count(*)=count(distinct raw_id) as ok
 from c where substr(sample_id,2)::int in (select c_custkey from customer) group by 1""")
def _(t):
    o = t.orders
    raw = F.concat(F.lit("o"), F.col("o_orderkey")).alias("raw_id")
    c = o.select(F.concat(F.lit("c"), "o_custkey").alias("sample_id"), raw).unionByName(o.where("o_orderkey % 9 = 0").select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("sample_id"), raw))
    q = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("sample_id"), F.col("c_custkey").cast("string").alias("conversation_id"))
    return jn.check_candidates(c, q, o.select(raw, F.col("o_custkey").cast("string").alias("conversation_id"))).withColumnRenamed("foreign", "foreign_n")
