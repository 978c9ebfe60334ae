"""Queries for readers, decoders, filters and sinks. Nested records are built from the tables, then decoded."""
import uuid

from pyspark.sql import functions as F

from ..operators import corpus
from ..session import shared_dir
from ..sources import readers as rd, sinks
from . import bindings as b, sqlkit as k
from .registry import plan


def _scratch(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@plan("src_records", "select conv_id::varchar as conv_id, turn::varchar as turn, text from conversations")
def _(t):
    c = t.conversations
    one = F.struct("conv_id", "turn", "text")
    m = F.col("turn") % 4
    v = (F.when(m == 0, F.to_json(one)).when(m == 1, F.to_json(F.array(one)))
         .when(m == 2, F.to_json(F.struct(F.array(one).alias("samples")))).otherwise(F.to_json(F.struct(F.array(one).alias("items")))))
    g = lambda x: F.get_json_object("value", f"$.{x}").alias(x)
    return rd.decode_records(c.select(v.alias("value"))).select(g("conv_id"), g("turn"), g("text"))


@plan("src_asset_dir", """
with a as (select l_orderkey, count(*) n, count(*) filter (l_returnflag='R') r from lineitem group by 1),
h as (select l_orderkey, l_linenumber n, 'part '||l_partkey x, row_number() over (partition by l_orderkey order by l_linenumber, 'part '||l_partkey) i from lineitem)
select o_orderkey::varchar as sample_id, o_orderstatus as query, coalesce(a.n,0)::bigint as n_history, coalesce(a.n,0)::bigint as n_facts, coalesce(r,0)::bigint as n_relations,
 case when h.n%2=1 then 'L'||h.n else 'turn_'||i end as turn_id, case when h.n is null then null when h.n%5=0 then '' else 's1' end as session_id, case when h.n%3=0 then 'unknown' when h.n is not null then 'user' end as speaker, x as text, h.n as turn_index, case when h.n%4=2 then 't'||h.n end as timestamp, case when h.n is not null then '{"n":'||h.n||'}' end as turn_metadata
from orders left join a on a.l_orderkey=o_orderkey left join h on h.l_orderkey=o_orderkey""")
def _(t):
    n = F.col("l_linenumber")
    li = t.lineitem.select(F.col("l_orderkey").cast("string").alias("parent_id"), "l_linenumber", "l_partkey", "l_returnflag")
    turn = F.struct(n.alias("turn_index"), F.when(n % 2 == 1, F.concat(F.lit("L"), n)).alias("id"), F.when(n % 5 != 0, "s1").alias("session_id"), F.when(n % 3 != 0, "user").alias("role"),
                    F.concat(F.lit("part "), "l_partkey").alias("content"), F.when(n % 4 == 2, F.concat(F.lit("t"), n)).alias("timestamp"), F.struct(n.alias("n")).alias("metadata"))
    documents = li.groupBy(F.col("parent_id").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("history"))
    facts = li.select("parent_id", F.col("l_partkey").alias("value"))
    rel = li.where("l_returnflag = 'R'").select("parent_id", "l_partkey")
    qa = t.orders.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderkey").cast("string").alias("parent_id"), F.col("o_orderstatus").alias("query"))
    samples, turns, _, _ = rd.load_assets(documents, qa, facts, rel)
    return samples.join(turns, "parent_id", "left").drop("parent_id")


def _session_records(t):
    """One record per session, as the session-map dataset writes it."""
    turn = F.struct("idx", F.col("speaker"), F.when(F.col("idx") % 3 != 0, F.col("turn_id")).alias("dia_id"), F.col("text"),
                    F.when(F.col("idx") % 4 == 0, F.lit("a photo")).alias("blip_caption"))
    s = b.turns(t).groupBy("conversation_id", "session_id", "session_no").agg(F.array_sort(F.collect_list(turn)).alias("ts"), F.min("timestamp").alias("d"))
    sid = F.concat_ws("-", "conversation_id", "session_no")
    conv = F.concat(F.lit('{"'), "session_id", F.lit('":'), F.to_json("ts"), F.lit(',"'), "session_id", F.lit('_date_time":"'), "d", F.lit('"}'))
    qa = F.to_json(F.array(F.struct(F.concat(F.lit("who spoke in "), "session_id").alias("question"), F.lit("both").alias("answer"), F.lit("1").alias("category"),
                                    F.array(F.concat(F.lit("D"), "session_no", F.lit(":1"))).alias("evidence"))))
    obs = F.concat(F.lit('{"'), "session_id", F.lit('_observation":{"user":[["said hello", "D1:1"],["agreed", ["D1:1","D1:2"]]]}}'))
    return s.select(F.concat(F.lit('{"sample_id":"'), sid, F.lit('","conversation":'), conv, F.lit(',"qa":'), qa, F.lit(',"observation":'), obs, F.lit("}")).alias("value"))


@plan("src_locomo", f"""with {b.TURNS} select conversation_id||'-'||session_no as conversation_id, session_no::bigint as session_no, session_id, timestamp, idx, turn_id, speaker,
 case when idx%4=0 then '[Image: a photo] ' else '' end || {k.norm('text')} as text,
 case when idx=1 then conversation_id||'-'||session_no||'__qa_0' end as cited_by from turns""")
def _(t):
    turns, samples = rd.load_sessions_qa(_session_records(t))
    e = rd.evidence_texts(samples, turns).where("evidence_text is not null").select("conversation_id", "turn_id", F.col("sample_id").alias("cited_by"))
    j = turns.join(e, ["conversation_id", "turn_id"], "left")
    return j.select("conversation_id", F.col("session_no").cast("bigint").alias("session_no"), "session_id", "timestamp", "idx", "turn_id", "speaker", "text", "cited_by")


@plan("src_observation_index", f"""with {b.TURNS}, s as (select distinct conversation_id||'-'||session_no c from turns)
 select c as conversation_id, 'D1:1' as turn_id, 'said hello' as fact from s union all select c, 'D1:1', 'agreed' from s union all select c, 'D1:2', 'agreed' from s""")
def _(t):
    return rd.observation_index(_session_records(t))


def _haystack_records(t):
    """One record per session, with every form a session, a turn and a name may take."""
    n, m, alias = F.col("idx"), F.col("session_no") % 4, F.col("idx") % 4
    said = F.when((F.col("session_no") % 3 == 0) & (n == 2), F.lit(" \n ")).otherwise(F.col("text"))
    who = lambda k: F.when(alias == k, F.col("speaker"))
    obj = F.to_json(F.struct(who(0).alias("role"), who(1).alias("speaker"), who(2).alias("author"), F.when(alias == 0, said).alias("content"), F.when(alias == 1, said).alias("text"),
                             F.when(alias == 2, said).alias("message"), F.when(alias == 3, said).alias("utterance"), (F.col("pos") % 3 == 0).alias("has_answer")))
    text = F.to_json(F.array(said))
    one = F.when((m == 3) & (n % 2 == 0), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(obj)
    s = b.turns(t).groupBy("conversation_id", "session_no", "session_id").agg(F.array_sort(F.collect_list(F.struct("idx", one.alias("j")))).alias("ts"), F.min("timestamp").alias("d"))
    arr = F.concat(F.lit("["), F.array_join(F.transform("ts", lambda x: x["j"]), ","), F.lit("]"))
    keyed = F.array_join(F.transform("ts", lambda x: F.concat(F.lit('"k'), x["idx"], F.lit('":'), x["j"])), ",")
    body = (F.when(m == 1, F.concat(F.lit('{"id":" own-'), "session_no", F.lit('","dialogue":3,"messages":'), arr, F.lit("}")))
            .when(m == 2, F.concat(F.lit('{"session":{'), keyed, F.lit("}}"))).otherwise(arr))
    ids = F.when(m < 2, F.concat(F.lit('["'), "session_id", F.lit('"]'))).when(m == 3, F.lit('[""]')).otherwise("[]")
    return s.select(F.concat(F.lit('{"question_id":"'), F.concat_ws("-", "conversation_id", "session_no"), F.lit('","haystack_session_ids":'), ids,
                             F.lit(',"haystack_dates":["'), "d", F.lit('"],"haystack_sessions":['), body, F.lit("]}")).alias("value"))


_HAYSTACK = f"""{b.TURNS}, hs as (select *, min(timestamp) over (partition by conversation_id, session_no) d, session_no%4=3 and idx%2=0 as plain, {k.norm('text')} x from turns),
 hay as (select conversation_id||'-'||session_no as sample_id, case session_no%4 when 0 then session_id when 1 then 'own-'||session_no else 'session_0' end as session_id, {k.norm('d')} as timestamp, (idx-1)::bigint as turn_index,
  case when plain or idx%4=3 then null else speaker end as role, x as text, pos%3=0 and not plain as has_answer from hs where x<>'' and not (session_no%3=0 and idx=2))"""


@plan("src_longmem_turn", f"""with {_HAYSTACK} select sample_id, session_id, timestamp, turn_index, session_id||':turn_'||turn_index as turn_id, session_id||'_'||(turn_index+1) as official_turn_id, coalesce(role,'unknown') as speaker, text, has_answer from hay""")
def _(t):
    return rd.load_haystack(_haystack_records(t), "turn").drop("s_no").withColumn("turn_index", F.col("turn_index").cast("bigint"))


@plan("src_longmem_session", f"""with {_HAYSTACK} select sample_id, session_id, timestamp, string_agg(coalesce(role||': ','')||text, chr(10) order by turn_index) as text, bool_or(has_answer) as has_answer, count(*)::bigint as n_turns
 from hay group by 1,2,3""")
def _(t):
    return rd.load_haystack(_haystack_records(t), "session").drop("s_no")


@plan("src_gold_ids", """select o_orderkey, case o_orderkey%3 when 0 then 's'||o_custkey when 1 then 'm'||o_orderkey||',m2' else '' end as gold_ids from orders""")
def _(t):
    m, none = F.col("o_orderkey") % 3, F.array().cast("array<string>")
    d = t.orders.select("o_orderkey", F.when(m == 0, F.array(F.lit("  "), F.concat(F.lit(" s"), F.col("o_custkey")))).otherwise(none).alias("answer_session_ids"),
                        F.when(m < 2, F.array(F.concat(F.lit("m"), F.col("o_orderkey")), F.lit("m2"))).otherwise(none).alias("meta_ids"))
    return rd.gold_ids(d, ["answer_session_ids", "meta_ids"]).select("o_orderkey", F.array_join("gold_ids", ",").alias("gold_ids"))


def _generic_records(t):
    c, m = t.conversations, F.col("turn") % 4
    text = F.substring(F.to_json(F.array("text")), F.lit(2), F.length(F.to_json(F.array("text"))) - 2)
    sid = F.concat(F.lit("x"), F.concat_ws("-", "conv_id", "turn"))
    said = F.to_json(F.struct(F.when(m == 0, F.concat(F.lit("T"), "turn")).alias("id"), F.when(m != 3, F.col("role")).alias("role"), F.col("text").alias("content"), F.when(m == 3, "Q").alias("turn_id"), F.concat(F.lit("2024-0"), m + 1).alias("timestamp")))
    history = (F.when(m == 0, F.concat(F.lit('"history":['), said, F.lit(',{"text":"second","speaker":"S"}]'))).when(m == 1, F.concat(F.lit('"conversation_history":['), text, F.lit(',"x"]')))
               .when(m == 2, F.concat(F.lit('"history":[],"conversation":{"sX":['), said, F.lit(',"str"],"sY":[{"text":"z","session_id":"own","turn_index":7}]}')))
               .otherwise(F.concat(F.lit('"conversation":{"sZ":"no list","sQ":['), said, F.lit("]}"))))
    names = F.to_json(F.struct(F.when(m == 0, sid).alias("sample_id"), F.when(m == 0, F.lit("other")).when(m != 2, sid).alias("question_id"), F.when(m == 1, F.lit("other")).when(m == 2, sid).alias("id"),
                               F.when(m % 2 == 0, F.concat(F.lit("q"), "turn")).alias("question"), F.when(m % 2 == 1, F.concat(F.lit("q"), "turn")).alias("query"), F.when(m == 0, "a0").alias("answer"),
                               F.when(m == 1, "a1").alias("gold_answer"), F.when(m == 2, "a2").alias("reference_answer"), F.when(m == 0, " temporal ").when(m == 3, "x").alias("task_type"),
                               F.when(m == 1, "single_hop").alias("question_type"), F.lit("ignored").alias("category")))
    extra = (F.when(m == 0, '"key_evidence_units":["e0"," ","e \\"two\\""],"evidence":["no"],"metadata":{"question_id":"mine","k":1},"conversation_id":"C"')
             .when(m == 1, '"key_evidence_units":[],"evidence":"single","required_fact_ids":[1,"f2"],"success_criterion":{"gold_answer":"g"},"gold_memory_ids":["m"]')
             .when(m == 2, '"forbidden_fact_ids":["f9"],"counterfactual":{"answer":"no"},"memory_worthy_facts":[{"fact_id":"f1","value":"v"},"skip",{"subject":"s","attribute":"a","fact_type":"t","timestamp":"T","source":{"x":1}}],'
                           '"supersede_relations":[{"old_fact_id":"f1","new_fact_id":"f2","reason":"r"}]')
             .otherwise('"metadata":"none","memory_worthy_facts":null,"counterfactual":null'))
    return c.select(F.concat(F.substring(names, F.lit(1), F.length(names) - 1), F.lit(","), history, F.lit(","), extra, F.lit("}")).alias("value"))


@plan("src_generic", """with g as (select *, turn%4 m, 'x'||conv_id||'-'||turn sid from conversations)
select sid as sample_id, case m when 0 then 'temporal' when 1 then 'single_hop' when 2 then 'generic' else 'x' end as task_type, 'q'||turn as question, case m when 0 then 'a0' when 1 then 'a1' when 2 then 'a2' else '' end as answer,
 session_id, turn_id, turn_index::int as turn_index, speaker, said as text,
 case m when 0 then ' temporal ' when 1 then 'single_hop' when 2 then 'generic' else 'x' end as question_type, case m when 0 then 'e0|e "two"' when 1 then 'single' else '' end as evidence, case m when 1 then '1,f2' else '' end as required, case m when 2 then 'f9' else '' end as forbidden,
 case m when 1 then '{"gold_answer":"g"}' when 0 then '{"gold_answer":"a0"}' when 2 then '{"gold_answer":"a2"}' else '{"gold_answer":""}' end as success_criterion, case m when 2 then '{"answer":"no"}' end as counterfactual,
 case m when 0 then 'conversation_id="C";k=1;question_id="mine"' when 1 then 'gold_memory_ids=["m"];question_id="'||sid||'"' else 'question_id="'||sid||'"' end as metadata, case when said=text and m<>1 then '2024-0'||(1+m) end as timestamp
from g, lateral (select * from (values (0, '', 'T'||turn, 0, role, text), (0, '', 'turn_2', 1, 'S', 'second'), (1, '', 'turn_1', 0, 'unknown', text), (1, '', 'turn_2', 1, 'unknown', 'x'),
 (2, 'sX', 'turn_1', 0, role, text), (2, 'sX', 'turn_2', 1, 'unknown', 'str'), (2, 'own', 'turn_3', 7, 'unknown', 'z'), (3, 'sQ', 'Q', 0, 'unknown', text)) v(k, session_id, turn_id, turn_index, speaker, said) where k=m)""")
def _(t):
    samples, turns = rd.load_generic(_generic_records(t))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return samples.join(turns, "sample_id").select("sample_id", "task_type", "question", "answer", "session_id", "turn_id", "turn_index", "speaker", "text", "question_type", F.array_join("key_evidence_units", "|").alias("evidence"),
                                                   F.array_join("required_fact_ids", ",").alias("required"), F.array_join("forbidden_fact_ids", ",").alias("forbidden"), "success_criterion", "counterfactual",
                                                   told.alias("metadata"), "timestamp")


@plan("src_generic_facts", """select 'x'||conv_id||'-'||turn as sample_id, kind, v.a, v.b, v.c, v.d, v.e from conversations, (values ('fact', 'f1', 'unknown', 'unknown_attribute', 'v', 'semantic'), ('fact', '', 's', 'a', '', 't'), ('relation', 'f1', 'f2', 'unknown_attribute', 'r', null)) v(kind, a, b, c, d, e) where turn%4=2""")
def _(t):
    rows = _generic_records(t)
    name = lambda df, kind, *cols: df.select("sample_id", F.lit(kind).alias("kind"), *[(F.col(x) if x else F.lit(None).cast("string")).alias(y) for x, y in zip(cols, "abcde")])
    return name(rd.generic_facts(rows), "fact", "fact_id", "subject", "attribute", "value", "fact_type").unionByName(name(rd.generic_relations(rows), "relation", "old_fact_id", "new_fact_id", "attribute", "reason", None))


@plan("src_prepare", f"""with {b.TURNS}, x as (select * from turns where {k.strip('text')}<>'')
 select 'turn' as granularity, raw_id as request_id, conversation_id, 'c1' as clause_id, pos, timestamp, md5(text) as sha from x
 union all select 'session', conversation_id||'::'||session_id, conversation_id, 'c'||idx, pos, timestamp, md5(speaker||': '||text) from x
 union all select 'conversation', conversation_id||'::CONVERSATION', conversation_id, 's'||session_no||'::c'||idx, pos, timestamp, md5(speaker||': '||text) from x""")
def _(t):
    out = None
    for g in ("turn", "session", "conversation"):
        r = rd.prepare(b.turns(t), g).withColumn("granularity", F.lit(g)).withColumn("sha", F.md5("text")).drop("text")
        out = r if out is None else out.unionByName(r)
    return out


def _window_sql(before, after):
    return f"""with {b.TURNS} select a.raw_id, string_agg(c.turn_id, ',' order by c.pos) as context, count(c.turn_id)::bigint as n_context
 from turns a left join turns c on c.conversation_id=a.conversation_id and c.session_id=a.session_id and c.pos between a.pos-{before} and a.pos+{after} and c.pos<>a.pos group by 1"""


def _window(t, before, after):
    n = corpus.neighbors(b.turns(t), ["conversation_id", "session_id"], "idx", before, after, ["turn_id"])
    return n.select("raw_id", F.nullif(F.array_join(F.transform("context", lambda x: x["turn_id"]), ","), F.lit("")).alias("context"),
                    F.size("context").cast("bigint").alias("n_context"))


@plan("src_neighbor_context", _window_sql(3, 3))
def _(t):
    return _window(t, 3, 3)


@plan("src_center_window", _window_sql(3, 2))
def _(t):
    return _window(t, 3, 2)


@plan("src_question_manifest", """select o_custkey::varchar as sample_id, count(distinct o_orderkey)::bigint as n_sessions, count(l_linenumber)::bigint as total,
 count(*) filter (l_returnflag='A')::bigint as cached, count(*) filter (l_returnflag='R')::bigint as rejected, count(*) filter (l_returnflag='N')::bigint as missing
 from orders left join lineitem on l_orderkey=o_orderkey group by 1""")
def _(t):
    q = t.orders.select(F.col("o_custkey").cast("string").alias("sample_id"), F.array("o_orderkey").alias("session_ids"))
    c = t.lineitem.select(F.col("l_orderkey").alias("session_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("raw_id"),
                          F.when(F.col("l_returnflag") == "A", "SUCCESS").when(F.col("l_returnflag") == "R", "REJECTED").alias("status"))
    return rd.question_manifest(q, c)


@plan("src_cache_manifest", f"""with {b.TURNS} select session_id, case when pos%3=0 then 'SUCCESS' when pos%5=1 then 'REJECTED' else 'MISSING' end as status, count(*)::bigint as n from turns group by 1,2""")
def _(t):
    r = b.turns(t)
    m = rd.cache_manifest(r, r.where("pos % 3 = 0"), r.where("pos % 5 = 1 or pos % 3 = 0"))
    return m.groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("n"))


@plan("src_precomputed_entries", """select conv_id::varchar as sample_id, case when turn%2=0 then 'e'||turn else conv_id||':'||turn end as entry_id, text as content,
 case when turn%2=0 then 'T'||turn end as first_source from conversations""")
def _(t):
    m = F.col("turn") % 2
    rec = F.when(m == 0, F.to_json(F.struct(F.concat(F.lit("e"), "turn").alias("entry_id"), F.col("text").alias("content"), F.array(F.concat(F.lit("T"), "turn")).alias("source_ids")))
                 ).otherwise(F.to_json(F.struct(F.col("text").alias("memory"))))
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("sample_id"), F.col("turn").alias("line_no"), rec.alias("value"))
    return rd.decode_entries(rows).select("sample_id", "entry_id", "content", F.try_element_at("source_ids", F.lit(1)).alias("first_source"))


@plan("src_corrupt_tolerant", "select event_id, event_type, user_id from events where event_id % 10 <> 9")
def _(t):
    whole = F.to_json(F.struct("event_id", "event_type", "user_id"))
    line = F.when(F.col("event_id") % 10 == 9, F.substring(whole, 1, 17)).otherwise(whole)
    good, _ = rd.split_journal(t.events.select(line.alias("value")), "event_id bigint, event_type string, user_id bigint")
    return good


@plan("flt_ids", """select c_custkey, c_name from customer where c_name between 'Customer#000000003' and 'Customer#000000041' or c_name='Customer#000000100' order by c_name limit 30""")
def _(t):
    return rd.filter_ids(t.customer.select("c_custkey", "c_name"), "c_name", ["Customer#000000003-000000041", "Customer#000000100", "nobody"], 30)


@plan("flt_category", f"with {b.JUDGED} select sample_id, system, category from judged where category <> '5'")
def _(t):
    return rd.filter_category(b.judged(t)).select("sample_id", "system", "category")


@plan("flt_shard", """select 'hash' as kind, o_orderkey from orders where ('0x'||substr(md5(o_orderkey::varchar),1,8))::bigint % 7 = 3
 union all select 'range', o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) rn from orders) where rn > 100 and rn <= 350""")
def _(t):
    o = t.orders.select("o_orderkey")
    r = rd.index_range(o.withColumn("g", F.lit(1)), ["g"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000), 100, 250)
    return rd.shard(o, "o_orderkey", 7, 3).select(F.lit("hash").alias("kind"), "o_orderkey").unionByName(r.select(F.lit("range").alias("kind"), "o_orderkey"))


# -- sinks -----------------------------------------------------------------

@plan("snk_partitioned", f"with {b.RUN_LOG} select system, count(*)::bigint as n, sum(position)::bigint as total from run_log group by 1")
def _(t):
    path = _scratch(t.spark, "by-system")
    sinks.write_by(b.run_log(t).select("sample_id", "system", "position", "latency"), ["system"], path)
    return t.spark.read.parquet(path).groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("total"))


@plan("snk_trace_row", """select doc_id::varchar as sample_id, source as system, '{"answer_metrics":{"answer_correct":'||case when quality=1 then 'true' else 'false' end||'},"retrieval_metrics":{"retrieval_hit":'
 ||case when toxic=1 then 'true' else 'false' end||'},"prompt_metrics":{"gold_in_prompt":'||case when quality=1 then 'true' else 'false' end||'},"post_evidence_metrics":{"failure_type":"'
 ||case when quality=1 then 'success' else 'unknown_failure' end||'"}}' as trace from labels join documents using (doc_id)""")
def _(t):
    r = b.judged(t).select("sample_id", "system", F.col("grade").alias("answer_correct"), F.col("toxic").alias("retrieval_hit"), F.col("grade").alias("gold_in_prompt"),
                           F.when(F.col("grade"), "success").otherwise("unknown_failure").alias("failure_type"))
    return sinks.trace_rows(r)


@plan("snk_csv_union_cols", """select n_nationkey::varchar as id, n_name as name, null::varchar as region from nation union all select r_regionkey::varchar, null, r_name from region""")
def _(t):
    path = _scratch(t.spark, "csv")
    sinks.write_csv([t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")),
                     t.region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("region"))], path)
    return t.spark.read.schema("id string, name string, region string").option("header", True).csv(path)


@plan("snk_manifest", """
with h as (select source, sha256('{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||'}') s from documents),
 g as (select source, count(*) n, sum(('0x'||substr(s,1,8))::bigint)::varchar a, sum(('0x'||substr(s,9,8))::bigint)::varchar b from h group by 1)
select source, 'documents' as dataset, n::bigint as rows, sha256(n||'|'||a||'|'||b) as fingerprint from g""")
def _(t):
    return sinks.manifest(t.documents, ["doc_id", "lang", "n_chars"], "documents", ["source"])


@plan("snk_cache_lineage", """
select (select count(*) from orders)::bigint as requests, (select count(*) from orders where o_orderkey%17<>0)::bigint as responses, 0::bigint as duplicate_requests,
 (select count(*) from orders where o_orderkey%17=0)::bigint as unanswered, 0::bigint as unrequested, (select count(*) from orders where o_orderkey%17<>0 and o_orderkey%19=0)::bigint as not_terminal_ok,
 (select count(*) from orders where o_orderkey%17<>0 and o_orderkey%23=0)::bigint as request_hash_mismatch, (select count(*) from orders where o_orderkey%17<>0 and o_orderkey%29=0)::bigint as response_hash_absent""")
def _(t):
    o = F.col("o_orderkey")
    q = t.orders.select(o.cast("string").alias("cell_id"), F.col("o_orderpriority").alias("request"))
    a = t.orders.where(o % 17 != 0).select(o.cast("string").alias("cell_id"), F.when(o % 19 == 0, "failed").otherwise("terminal_ok").alias("status"),
                                           F.when(o % 23 == 0, "stale").otherwise(F.sha2("o_orderpriority", 256)).alias("request_sha256"),
                                           F.when(o % 29 == 0, "").otherwise(F.sha2("o_orderstatus", 256)).alias("response_sha256"))
    return sinks.close_lineage(q, a)


@plan("snk_predictions", f"""with {b.RUN_LOG} select sample_id, system, position, case when trim(pred_answer)<>'' then trim(pred_answer) when error is not null then '[SYSTEM_ERROR]' else '' end as hypothesis from run_log""")
def _(t):
    r = b.run_log(t)
    p = sinks.predictions(r.withColumn("sample_id", F.concat_ws("|", "sample_id", "position")))
    return p.select(F.substring_index("sample_id", "|", 1).alias("sample_id"), "system", F.substring_index("sample_id", "|", -1).cast("bigint").alias("position"), "hypothesis")


@plan("snk_judge_queue", f"""with {b.QUESTIONS} select 's' as system, q.sample_id, q.speaker as question_type, q.query_text as question, '' as gold_answer, q.query_text as pred_answer,
 q.pos%2=0 as strict_correct, 0.5::double as answer_f1, '' as failure_type, coalesce(g.turn_id,'') as gold_memory_ids,
 coalesce('- '||g.turn_id||': '||{k.norm('t.text')},'') as gold_evidence_text from questions q left join gold g on g.sample_id=q.sample_id left join turns t on t.raw_id=g.raw_id""")
def _(t):
    g = b.gold(t).join(b.turns(t).select("raw_id", "text"), "raw_id").select("sample_id", F.array("turn_id").alias("gold_memory_ids"), F.array(
        F.struct(F.col("turn_id").alias("source_id"), "turn_id", "text")).alias("gold_evidence_units"))
    r = b.questions(t).join(g, "sample_id", "left").select(
        F.lit("s").alias("system"), "sample_id", F.col("speaker").alias("question_type"), F.col("query_text").alias("question"), F.lit(None).cast("string").alias("gold_answer"),
        F.col("query_text").alias("pred_answer"), (F.col("pos") % 2 == 0).alias("answer_correct"), F.lit(0.5).alias("token_f1"), F.lit(None).cast("string").alias("failure_type"),
        F.coalesce("gold_memory_ids", F.array().cast("array<string>")).alias("gold_memory_ids"),
        F.coalesce("gold_evidence_units", F.array().cast("array<struct<source_id:string,turn_id:string,text:string>>")).alias("gold_evidence_units"))
    return sinks.judge_queue(r)
