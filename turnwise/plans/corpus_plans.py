"""Queries for corpus compilation and the stores built over turns."""
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as cp, packing as pk
from . import bindings as b, sqlkit as k
from .registry import plan

# -- a sidecar over the turns ----------------------------------------------

SIDE = f"""{b.TURNS}, sd as (select *, conversation_id::int%3 as cm, regexp_extract_all(lower(text),'[a-z0-9'']+') w from turns),
 s0 as (select *, coalesce(w[1],'') w1, coalesce(w[2],'') w2, coalesce(w[3],'') w3 from sd)"""


def sidecar(t):
    """Conversations 0 mod 3 have base facts only, 1 mod 3 speech acts, 2 mod 3 a flat contextual list."""
    tt = b.turns(t)
    w = tx.tokens("text", "plain")
    s = tt.select("raw_id", "conversation_id", "pos", "speaker", (F.col("conversation_id").cast("int") % 3).alias("cm"),
                  *[F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("")).alias(f"w{i}") for i in (1, 2, 3)])
    s = cp.previous(s, ["conversation_id"], "pos", ["raw_id"])
    nul = F.lit(None).cast("string")
    fact = lambda v: F.struct(F.col("speaker").alias("subject"), F.col("w1").alias("relation"), v.alias("value"), nul.alias("event"), F.lit("now").alias("time"), F.lit("ACTUAL").alias("modality"), F.lit("POSITIVE").alias("polarity"))
    prev = F.when(F.col("prev_raw_id").isNotNull(), F.array("prev_raw_id")).otherwise(F.array().cast("array<string>"))
    prop = F.when(F.col("pos") % 2 == 1, F.struct(F.col("speaker").alias("subject"), F.col("w1").alias("relation"), F.col("w3").alias("value"), nul.alias("event"), nul.alias("time"),
                                                  F.array("raw_id", "prev_raw_id").alias("source_raw_ids")))
    act = F.struct(F.when(F.col("pos") % 2 == 1, "CONFIRMATION").otherwise("ASSERTION").alias("act"), F.col("w3").alias("center_quote"), prev.alias("antecedent_raw_ids"),
                   F.when(F.col("pos") % 4 != 3, fact(F.col("w2"))).alias("assertion"), prop.alias("resolved_proposition"))
    link = F.struct(F.col("speaker").alias("owner"), F.col("w1").alias("event"), F.lit("same").alias("relation"), prev.alias("antecedent_raw_ids"))
    none = lambda like: F.filter(F.array(like), lambda x: F.lit(False))
    speech = F.col("cm") == 1
    ctx = F.when(F.col("cm") > 0, F.struct(
        F.col("w2").alias("center_summary"), prev.alias("antecedent_raw_ids"), F.when(speech, F.array(act)).otherwise(none(act)).alias("speech_acts"),
        F.when(speech, F.array(link)).otherwise(none(link)).alias("occurrence_links"), F.when(speech, none(fact(F.col("w2")))).otherwise(F.array(fact(F.col("w2")))).alias("assertions"), F.lit("ROLE").alias("evidence_role")))
    bf = lambda n, v: F.struct(F.concat("raw_id", F.lit(f"::l2::{n}")).alias("assertion_id"), F.upper("speaker").alias("subject"), F.col("w1").alias("surface_relation"), v.alias("value"), nul.alias("event"), F.lit("then").alias("time"),
                               F.lit("PLANNED").alias("modality"), F.lit("POSITIVE").alias("polarity"), F.concat_ws(" ", "speaker", "w1").alias("retrieval_text"))
    return s.select("raw_id", ctx.alias("contextual"), F.array(bf(1, F.col("w2")), bf(2, F.col("w3")), bf(3, F.col("w3"))).alias("base_l2_direct"),
                    F.when(F.col("cm") > 0, "V41_VALIDATED").otherwise("BASE_REUSED").alias("sidecar_status"))


_ACT = "cm=1 and pos%4<>3"
_AS = f"""asrt as (select raw_id||case when cm=1 then '::v41::a1' else '::ctx::a1' end assertion_id, raw_id, speaker subject, w1 relation, w2 value, 'CENTER_RAW' authority, case when cm=1 then 'ASSERTION' else 'ROLE' end speech_act, case when cm=1 then 0 else 1 end kind, speaker||' '||w1||' '||w2||'  now' retrieval_text from s0 where ({_ACT}) or cm=2
  union all select raw_id||'::l2::'||n, raw_id, upper(speaker), w1, case when n=1 then w2 else w3 end, 'BASE_VALIDATED', 'ASSERTION', 2, upper(speaker)||' '||w1||' '||case when n=1 then w2 else w3 end||' '||speaker||' '||w1 from s0, (values (1),(2),(3)) v(n)
   where cm=0 or (n=1 and not (({_ACT}) or cm=2)) or (n=2 and (w3<>w2)))"""
_AS = _AS.replace("or (n=2 and (w3<>w2))", "or (n=2 and w3<>w2)")


@plan("cmp_assertions", f"with {SIDE}, {_AS} select assertion_id, raw_id, subject, relation, value, authority, speech_act, retrieval_text from asrt")
def _(t):
    return cp.assertions(sidecar(t)).select("assertion_id", "raw_id", "subject", "relation", "value", "authority", "speech_act", "retrieval_text")


@plan("cmp_propositions", f"""with {SIDE} select raw_id||'::v41::p1' as proposition_id, raw_id, 'CONFIRMATION' as speech_act, speaker||' '||w1||' '||w3||'  ' as retrieval_text from s0 where cm=1 and pos%2=1
 union all select raw_id||'::ctx::p1', raw_id, null, speaker||' '||w1||' '||w2||'  now' from s0 where cm=2""")
def _(t):
    return cp.propositions(sidecar(t)).select("proposition_id", "raw_id", "speech_act", "retrieval_text")


@plan("cmp_edges", f"""with {SIDE}, p as (select a.*, z.raw_id prev from s0 a left join turns z on z.conversation_id=a.conversation_id and z.pos=a.pos-1)
select raw_id as source_raw_id, prev as target_raw_id, 'CONFIRMATION' as edge_type, raw_id||'::v41::p1' as proposition_id, null::int as occurrence_index from p where cm=1 and pos%2=1 and prev is not null
union all select raw_id, prev, 'ANTECEDENT', null, null from p where cm>0 and prev is not null union all select raw_id, prev, 'OCCURRENCE', null, 1 from p where cm=1 and prev is not null""")
def _(t):
    return cp.edges(sidecar(t))


@plan("cmp_postings", f"""with {SIDE}, {_AS} select subject as entity, raw_id, assertion_id, 'SUBJECT' as role from asrt where kind<>1 union all select value, raw_id, assertion_id, 'VALUE' from asrt where kind=0 and value<>''""")
def _(t):
    return cp.postings(cp.assertions(sidecar(t))).select("entity", "raw_id", "assertion_id", "role")


@plan("cmp_raw_views", f"""with {SIDE}, {_AS}, b as (select raw_id, string_agg(retrieval_text, ' ' order by assertion_id) bt from asrt where kind=2 group by 1)
select s.raw_id, s.session_id as source_session_id, case when cm>0 then 'V41_VALIDATED' else 'BASE_REUSED' end as sidecar_status, md5(concat_ws(' ', speaker, timestamp, text, case when cm>0 then w2 end, case when cm=1 then w3 end, case when {_ACT} then speaker||' '||w1||' '||w2||'  now' end,
 case when cm=1 and pos%2=1 then speaker||' '||w1||' '||w3||'  ' end, case when cm=1 then speaker||' '||w1||' same' end, bt)) as text_sha from s0 s left join b using (raw_id)""")
def _(t):
    return cp.raw_views(sidecar(t), b.turns(t)).select("raw_id", "source_session_id", "sidecar_status", F.md5("retrieval_text").alias("text_sha"))


@plan("cmp_sidecar_merge", f"""with {b.TURNS} select raw_id, case when pos%2=0 and not (pos%3=0 or pos%5=0) then 'BASE_REUSED' when pos%3=0 or pos%5=0 then 'V41_VALIDATED' else 'V41_UNCERTAIN_FALLBACK' end as sidecar_status, case when pos%3=0 then 'late' when pos%5=0 then 'early' end as contextual from turns""")
def _(t):
    tt, p = b.turns(t), F.col("pos")
    man = tt.select("raw_id", F.when(p % 2 == 0, "SELF_CONTAINED_LLM").otherwise("CONTEXT_REPARSE_REQUIRED").alias("status"))
    base = tt.select("raw_id", F.array("text").alias("base_l2_direct"))
    early = tt.where("pos % 5 = 0 or pos % 3 = 0").select("raw_id", F.when(p % 5 == 0, "VALIDATED").otherwise("UNCERTAIN").alias("status"), F.lit("early").alias("contextual"))
    late = tt.where("pos % 3 = 0").select("raw_id", F.lit("VALIDATED").alias("status"), F.lit("late").alias("contextual"))
    return cp.merge_sidecar(man, base, [early, late]).select("raw_id", "sidecar_status", "contextual")


# -- stores ----------------------------------------------------------------

@plan("cmp_turn_entries", f"with {b.TURNS} select 'turn:'||raw_id as entry_id, conversation_id, speaker||': '||{k.strip('text')} as content, timestamp as created_at, turn_id as source_id from turns")
def _(t):
    return cp.turn_entries(b.turns(t)).select("entry_id", "conversation_id", "content", "created_at", "source_id")


@plan("cmp_session_entries", f"with {b.TURNS} select conversation_id, session_id, count(*)::bigint as message_count, min(pos) as first_pos, max(pos) as last_pos, arg_min(turn_id,pos) as first_turn_id, arg_max(turn_id,pos) as last_turn_id, arg_min(timestamp,pos) as session_date from turns group by 1,2")
def _(t):
    return cp.session_entries(b.turns(t))


_BK = "bk as (select *, case when pos%8=7 then 'session_x' when pos%8=6 then 'chunk_0000' else timestamp end bucket, case when pos%8>=6 then '' else timestamp end ts from turns)"


def _bucketed(t):
    m = F.col("pos") % 8
    tt = b.turns(t).withColumn("timestamp", F.when(m >= 6, "").otherwise(F.col("timestamp"))).withColumn("session_id", F.when(m == 7, "x").when(m == 6, "").otherwise(F.col("session_id")))
    return cp.time_buckets(tt)


@plan("cmp_time_buckets", f"with {b.TURNS}, {_BK} select conversation_id, bucket, count(*)::bigint as n_turns, min(pos) as first_pos, arg_min(nullif(ts,''), case when ts<>'' then pos end) as bucket_time from bk group by 1,2")
def _(t):
    return _bucketed(t)[1]


_PAIR = f"""{_BK}, pr0 as (select *, (row_number() over (partition by conversation_id, bucket order by pos)-1)//2 pair from bk), pairs as (select conversation_id, bucket, pair::bigint pair, string_agg(speaker||': '||text, chr(10) order by pos) content, string_agg(turn_id, ',' order by pos) ids from pr0 group by 1,2,3)"""


@plan("cmp_turn_pairs", f"with {b.TURNS}, {_PAIR} select conversation_id, bucket, pair, content, ids as source_ids from pairs")
def _(t):
    return cp.turn_pairs(_bucketed(t)[0]).withColumn("source_ids", F.array_join("source_ids", ","))


@plan("cmp_bucket_store", f"""with {b.TURNS}, {_PAIR} select conversation_id, bucket, conversation_id||'::'||bucket||'::summary' as entry_id, count(*)||' turns' as content, 'summary' as level, 0::bigint as level_order from bk group by 1,2
union all select conversation_id, bucket, conversation_id||'::'||bucket||'::pair'||pair, content, 'pair', pair+1 from pairs""")
def _(t):
    rows, head = _bucketed(t)
    return cp.bucket_store(cp.turn_pairs(rows), head.select("conversation_id", "bucket", F.concat("n_turns", F.lit(" turns")).alias("summary")))


@plan("cmp_passage_groups", f"""with {b.TURNS} select conversation_id, (pos//3)::bigint as passage, string_agg('['||turn_id||' | '||session_id||' | '||timestamp||'] '||speaker||': '||text, chr(10) order by pos) as content, string_agg(turn_id, ',' order by pos) as source_ids from turns group by 1,2""")
def _(t):
    return cp.passages(b.turns(t), 3).withColumn("source_ids", F.array_join("source_ids", ","))


@plan("cmp_perspective_batches", f"""with {b.TURNS}, sp as (select distinct conversation_id, speaker perspective from turns) select t.conversation_id, session_id, perspective, ((idx-1)//3)::bigint as batch, string_agg(case when speaker=perspective then 'user' else 'assistant' end||': '||text, chr(10) order by pos) as messages,
 string_agg(turn_id, ',' order by pos) as turn_ids, arg_min(timestamp,pos) as first_timestamp from turns t join sp using (conversation_id) group by 1,2,3,4""")
def _(t):
    return cp.perspective_batches(b.turns(t), 3)


_GIST = f"""coalesce(nullif({k.strip("array_to_string(list_filter(list_transform(string_split_regex(text,'\\r\\n|\\n|\\r'), lambda x: " + k.strip('x') + "), lambda x: x<>'')[1:3],' ')")},'')[1:420], text[1:220])"""


@plan("cmp_extractive_gist", f"select doc_id, {_GIST} as gist from documents")
def _(t):
    return t.documents.select("doc_id", cp.gist("text").alias("gist"))


@plan("cmp_gist_store", f"""with {b.TURNS} select conversation_id, pos as page, 'gist' as level, {_GIST} as content, conversation_id||'::page'||pos||'::gist' as entry_id from turns union all select conversation_id, pos, 'page', text, conversation_id||'::page'||pos||'::page' from turns""")
def _(t):
    return cp.gist_store(b.turns(t).select("conversation_id", F.col("pos").alias("page"), F.col("text").alias("content")))


@plan("cmp_core_archive_store", f"""with {b.TURNS} select conversation_id, 'core:'||speaker as entry_id, count(*)||' turns' as content, 'core' as memory_bucket from turns group by conversation_id, speaker union all select conversation_id, raw_id, text, 'archive' from turns""")
def _(t):
    tt = b.turns(t)
    blocks = tt.groupBy("conversation_id", "speaker").agg(F.count(F.lit(1)).alias("n")).select("conversation_id", F.concat(F.lit("core:"), "speaker").alias("entry_id"), F.concat("n", F.lit(" turns")).alias("content"))
    return cp.core_archive(blocks, tt.select("conversation_id", F.col("raw_id").alias("entry_id"), F.col("text").alias("content")))


@plan("cmp_self_contained", f"with {b.TURNS} select raw_id as center_raw_id, 'c1' as clause_id, 'c1::unit::1' as unit_id, text as span, 'NON_PROPOSITIONAL' as status, 0::bigint as n_assertions from turns")
def _(t):
    return cp.self_contained(b.turns(t)).drop("reason")


@plan("cmp_request_view", f"""with {b.TURNS} select a.raw_id, case when pos%2=0 then 'k1' else 'c1' end as clause_id, text as clause_text, (select count(*) from turns z where z.conversation_id=a.conversation_id and z.session_id=a.session_id and abs(z.pos-a.pos)<=3 and z.pos<>a.pos)::bigint as n_context from turns a""")
def _(t):
    n = cp.neighbors(b.turns(t), ["conversation_id", "session_id"], "idx", 3, 3, ["raw_id"])
    one = F.struct(F.lit("k1").alias("clause_id"), F.col("text").alias("text"))
    r = n.select(F.struct("raw_id", "speaker", "timestamp", F.col("session_id").alias("source_session_id"), F.lit(False).alias("has_answer"), "text",
                          F.when(F.col("pos") % 2 == 0, F.array(one)).otherwise(F.filter(F.array(one), lambda x: F.lit(False))).alias("clauses")).alias("center"), F.col("context").alias("context_only"))
    v = cp.request_view(r)
    c = F.element_at("center.clauses", 1)
    return v.select("center.raw_id", c["clause_id"].alias("clause_id"), c["text"].alias("clause_text"), F.size("context_only").cast("bigint").alias("n_context"))


@plan("txt_history_messages", f"""with {b.TURNS} select conversation_id, pos, case speaker when 'system' then 'system' when 'assistant' then 'assistant' else 'user' end as role, {k.strip('text')} as content,
 '[source turn_id='||turn_id||'; session_id='||session_id||'; session_date='||timestamp||'; speaker='||speaker||']'||chr(10)||speaker||': '||{k.strip('text')} as sourced, '['||(pos+1)||'] '||speaker||': '||{k.strip('text')} as line from turns where {k.strip('text')}<>''""")
def _(t):
    return cp.history_messages(b.turns(t))


@plan("txt_session_block", f"""with {b.TURNS}, p as (select *, lag(session_id) over w ps, lag(timestamp) over w pt from turns window w as (partition by conversation_id order by pos))
select conversation_id, pos, case when ps is distinct from session_id or pt is distinct from timestamp then '[Session session_id='||session_id||'; session_date='||timestamp||']' end as header, '['||strftime(timestamp::date,'%Y/%m/%d (%a) %H:%M')||'] '||speaker||': '||{k.strip('text')} as line from p""")
def _(t):
    return cp.render_sessions(b.turns(t))


@plan("txt_memory_block", f"""with {b.QUESTIONS} select q.sample_id, (t.pos-q.pos+1)::bigint as rank, 'e'||t.pos as entry_id, '- [memory_id=e'||t.pos||'; source_ids='||case when t.pos%3=0 then 'zz,'||t.turn_id when t.pos%3=1 then t.session_id else 'zz' end||'; session_id='||case when t.pos%4=0 then 'own' else t.session_id end
 ||'; session_date='||t.timestamp||'; speaker='||case when t.pos%3=1 then f.speaker else t.speaker end||']'||chr(10)||'  '||{k.strip('t.text')} as line
 from questions q join turns t on t.conversation_id=q.conversation_id and t.pos between q.pos and q.pos+2 left join turns f on f.conversation_id=t.conversation_id and f.session_id=t.session_id and f.idx=1 where t.pos%3<>2""")
def _(t):
    q = b.questions(t).select("sample_id", "conversation_id", F.col("pos").alias("q"))
    tt = b.turns(t).where("pos % 3 <> 2").withColumn("q", F.explode(F.array("pos", F.col("pos") - 1, F.col("pos") - 2)))
    j = q.join(tt, ["conversation_id", "q"])
    m = F.col("pos") % 3
    r = j.select("sample_id", "conversation_id", (F.col("pos") - F.col("q") + 1).cast("bigint").alias("rank"), F.concat(F.lit("e"), "pos").alias("entry_id"),
                 F.when(m == 0, F.concat(F.upper("speaker"), F.lit(": "), "text")).otherwise(F.col("text")).alias("content"),
                 F.when(m == 0, F.array(F.lit("zz"), F.col("turn_id"))).otherwise(F.array("session_id")).alias("source_ids"), F.when(F.col("pos") % 4 == 0, "own").alias("session_id"),
                 F.lit(None).cast("string").alias("session_date"), F.lit(" ").alias("speaker"))
    return cp.render_memory(r, b.turns(t))


# -- layered views ---------------------------------------------------------

FO = """fo as (select o_orderkey::varchar assertion_id, 'c'||o_custkey raw_id, c_name subject, o_orderpriority relation, case when o_orderkey%10=0 then '0' else o_orderstatus end value, c_mktsegment value_type, case when o_orderkey%3=0 then 'occ'||(o_orderkey%5) else '' end occ,
  case when o_orderkey%2=0 then strftime(o_orderdate,'%Y-%m') else '' end tm, case when o_orderkey%7=0 then 'PLANNED' else 'ACTUAL' end modality, case when o_orderkey%4=1 then 'NEGATIVE' else 'POSITIVE' end polarity, case when o_orderkey%3<>1 then c_name end time_owner, o_orderdate, o_orderkey, c_nationkey from orders join customer on o_custkey=c_custkey)"""


def facts_o(t):
    o = F.col("o_orderkey")
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(o.cast("string").alias("assertion_id"), F.concat(F.lit("c"), "o_custkey").alias("raw_id"), F.col("c_name").alias("subject"), F.col("o_orderpriority").alias("relation"),
                    F.when(o % 10 == 0, "0").otherwise(F.col("o_orderstatus")).alias("value"), F.col("c_mktsegment").alias("value_type"), F.when(o % 3 == 0, F.concat(F.lit("occ"), o % 5)).otherwise("").alias("occurrence_id"),
                    F.when(o % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("").alias("time"), F.create_map(F.lit("agent"), F.col("c_mktsegment"), F.lit("participant"), F.when(o % 4 == 0, F.col("c_name")).otherwise("")).alias("roles"),
                    F.lit("home").alias("location"), F.when(o % 7 == 0, "PLANNED").otherwise("ACTUAL").alias("modality"), F.when(o % 4 == 1, "NEGATIVE").otherwise("POSITIVE").alias("polarity"),
                    F.when(o % 3 != 1, F.col("c_name")).alias("time_owner"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), o.alias("ord"), F.col("c_nationkey").cast("string").alias("conversation_id"), F.lit("s").alias("session_id"))


_KV = "case when value in ('','0') then 'unknown' else lower(trim(value)) end"
_KO = "case when occ='' then 'unknown' else occ end"


@plan("cmp_entity_view", f"with {FO}, m as (select assertion_id, raw_id, relation, subject as entity from fo union select assertion_id, raw_id, relation, value_type from fo) select entity, relation, count(*)::bigint as n_assertions, count(distinct raw_id)::bigint as n_raws, min(assertion_id) as first_assertion from m group by 1,2")
def _(t):
    return cp.entity_view(facts_o(t))


@plan("cmp_occurrence_view", f"""with {FO}, x as (select *, raw_id||'::'||occ oc from fo where occ<>'') select oc as occurrence, facet, member, count(*)::bigint as n from (select oc, 'participant' facet, value_type member from x union all select oc, 'participant', subject from x where o_orderkey%4=0
 union all select oc, 'time', tm from x where tm<>'' union all select oc, 'location', 'home' from x union all select oc, 'modality', modality from x) group by 1,2,3""")
def _(t):
    return cp.occurrence_view(facts_o(t))


@plan("cmp_collection_view", f"with {FO} select lower(subject)||'|'||lower(relation)||'|'||lower(value_type) as collection_key, {_KV}||'|'||{_KO} as member, count(*)::bigint as n_assertions, count(distinct raw_id)::bigint as n_raws, count(distinct case when occ<>'' then raw_id||'::'||occ end)::bigint as n_occurrences from fo group by 1,2")
def _(t):
    return cp.collection_view(facts_o(t))


@plan("cmp_competition_view", f"""with {FO}, a as (select lower(subject)||'|'||lower(relation)||'|'||{_KO} competition_key, {_KV} alternative, count(*)::bigint n_assertions, count(distinct raw_id)::bigint n_raws, string_agg(distinct modality, ',' order by modality) modalities, string_agg(distinct polarity, ',' order by polarity) polarities from fo group by 1,2), m as (select competition_key, count(*)::bigint n_alternatives from a group by 1 having count(*)>1)
select competition_key, alternative, n_assertions, n_raws, n_alternatives, modalities, polarities from a join m using (competition_key)""")
def _(t):
    c = cp.competition_view(facts_o(t))
    return c.withColumn("modalities", F.array_join("modalities", ",")).withColumn("polarities", F.array_join("polarities", ","))


@plan("cmp_competition_members", f"""with {FO}, a as (select *, lower(subject)||'|'||lower(relation)||'|'||{_KO} competition_key, {_KV} alternative from fo) select competition_key, alternative, assertion_id, raw_id from a
where competition_key in (select competition_key from a group by 1 having count(distinct alternative)>1)""")
def _(t):
    return cp.competition_members(facts_o(t))


@plan("cmp_collection_members", f"with {FO} select lower(subject)||'|'||lower(relation)||'|'||lower(value_type) as collection_key, {_KV}||'|'||{_KO} as member, assertion_id, raw_id, case when occ<>'' then raw_id||'::'||occ end as occurrence, 'OPEN' as frontier_status from fo")
def _(t):
    return cp.collection_members(facts_o(t))


@plan("cmp_timeline_view", f"with {FO} select lower(subject)||'|'||lower(relation) as timeline_key, assertion_id, raw_id, case when occ<>'' then raw_id||'::'||occ end as occurrence, tm as time_expression, time_owner, 'UNORDERED' as ordering_status from fo where tm<>''")
def _(t):
    return cp.timeline_view(facts_o(t))


@plan("cmp_supersession", f"""with {FO}, n as (select *, lead(value) over w nv, lead(assertion_id) over w na from fo window w as (partition by c_nationkey, lower(value_type), lower(relation) order by strftime(o_orderdate,'%Y-%m-%d'), raw_id, o_orderkey))
select assertion_id, case when na is not null and nv<>value then 'SUPERSEDED' else 'CURRENT' end as status, case when na is not null and nv<>value then na end as superseded_by from n""")
def _(t):
    f = facts_o(t).withColumn("subject", F.col("value_type"))
    return cp.supersede(f, block=F.substring("timestamp", 1, 7)).select("assertion_id", "status", "superseded_by")


# -- evidence interface ----------------------------------------------------

_EI = f"""{b.TURNS}, {b.FACTS}, {b.EDGES}, lk as (select * from edges where edge_type in ('ANTECEDENT','OCCURRENCE')), st as (select *, case when pos%3=0 then 'V41_VALIDATED' else 'BASE_REUSED' end ss, case when pos%5=0 then 'CONFIRMATION' when pos%5=1 then 'REACTION' when pos%5=2 then 'QUESTION' end act, pos%2=0 as keepf from turns),
 sg as (select distinct f.raw_id, lower(subject) s, lower(relation) r, lower(case when value<>'' or true then value end) v, lower(event) e, lower(tm) t from facts f join st using (raw_id) where keepf),
 bd as (select raw_id, count(*) n, count(distinct nullif(v,'')) nv, count(distinct nullif(t,'')) nt, list_distinct(flatten(list({k.toks("s||' '||r||' '||v||' '||e")}))) terms from sg group by 1),
 pv as (select a.*, z.raw_id pr, z.text ptext, z.speaker ps from st a left join turns z on z.conversation_id=a.conversation_id and z.session_id=a.session_id and z.pos=a.pos-1),
 j as (select pv.*, coalesce(n,0) n, coalesce(nv,0) nv, coalesce(nt,0) nt, coalesce(terms,[]) terms, (select count(distinct target_raw_id) from lk where source_raw_id=pv.raw_id) na, exists(select 1 from lk where target_raw_id=pv.raw_id) ia from pv left join bd using (raw_id)),
 x as (select *, case when ss='BASE_REUSED' and pr is not null then case when ends_with({k.norm('ptext')},'?') and ps<>speaker then 'ANSWER_TO_QUESTION' when regexp_matches(lower({k.norm('text')}),'^(yes|yeah|yep|no|nope|sure|thanks|thank you|exactly|definitely|absolutely|that|this|it|they|he|she|sounds|wow|great|nice|sorry)\\b') then 'DISCOURSE_RESPONSE'
   when len(list_intersect(terms, {k.tokset('ptext')}))>=2 then 'SHARED_EVENT_TERMS' end end rs from j)"""


@plan("cmp_evidence_interface", f"""with {_EI} select raw_id, conversation_id, n::bigint as n_bindings, nv::bigint as n_values, nt::bigint as n_times, coalesce(act,'') as speech_acts, na::bigint as n_antecedents, case when rs is not null then pr end as linked_raw_id, rs as link_reason, ia as is_antecedent,
 coalesce(act in ('CONFIRMATION','REACTION'),false) as is_response, coalesce(act='CONFIRMATION',false) as is_strong_response, n>0 or coalesce(act in ('CONFIRMATION','REACTION'),false) as is_carrier, n=0 and coalesce(act='QUESTION',false) as social_only from x""")
def _(t):
    p = F.col("pos")
    raws = b.turns(t).withColumn("sidecar_status", F.when(p % 3 == 0, "V41_VALIDATED").otherwise("BASE_REUSED")).withColumn("raw_text", F.col("text")).withColumn("retrieval_text", F.col("text"))
    acts = b.turns(t).where("pos % 5 < 3").select("raw_id", F.when(p % 5 == 0, "confirmation").when(p % 5 == 1, "REACTION").otherwise("QUESTION").alias("act"), F.lit(False).alias("resolved"))
    return cp.evidence_interface(raws, b.facts(t).where("pos % 2 = 0"), b.edges(t), acts)


# -- chunks and packing ----------------------------------------------------

@plan("cmp_merge_chunks", """with f as (select l_orderkey raw_id, l_suppkey%3 chunk, l_linenumber pos, l_partkey, row_number() over (partition by l_orderkey, l_suppkey%3, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) d from lineitem),
 g as (select * from f where d=1), n as (select *, 'a'||row_number() over (partition by raw_id order by chunk, pos) new_id from g), u as (select raw_id, chunk, string_agg(new_id, ',' order by pos) ids from n group by 1,2)
select n.raw_id, n.chunk, n.pos, n.new_id, u.ids as unit_links from n join u on u.raw_id=n.raw_id and u.chunk=n.chunk""")
def _(t):
    f = t.lineitem.select(F.col("l_orderkey").alias("raw_id"), (F.col("l_suppkey") % 3).alias("chunk"), F.col("l_linenumber").alias("pos")).distinct().withColumn("assertion_id", F.concat(F.lit("x"), "pos"))
    u = f.groupBy("raw_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "assertion_id"))), lambda x: x["assertion_id"]).alias("assertion_ids")).withColumn("unit_id", F.lit("u"))
    a, links = cp.merge_chunks(f, u)
    return a.join(links.select("raw_id", "chunk", F.col("assertion_ids").alias("unit_links")), ["raw_id", "chunk"]).select("raw_id", "chunk", "pos", "new_id", "unit_links")


@plan("cmp_unit_links", f"""with {b.TURNS}, {b.FACTS}, un as (select raw_id, 'c'||((ord+1)//2) clause_id, 'u'||ord unit_id, retrieval_text span, list_distinct(list_filter(regexp_extract_all(lower(retrieval_text),'[\\p{{L}}\\p{{N}}\\p{{M}}_''-]+'), lambda x: length(x)>=4)) sw from facts),
 fa as (select assertion_id, raw_id, ord, case when ord%2=0 then 'c'||((ord+1)//2) end cid, list_distinct(list_filter(regexp_extract_all(lower(retrieval_text),'[\\p{{L}}\\p{{N}}\\p{{M}}_''-]+'), lambda x: length(x)>=4)) fw from facts),
 cand as (select f.assertion_id, count(*) n, min(u.unit_id) u from fa f join un u on u.raw_id=f.raw_id and u.clause_id=f.cid group by 1),
 sc as (select f.assertion_id, u.unit_id, len(list_intersect(fw,sw)) o, len(list_intersect(fw,sw))/len(sw) s from fa f join un u on u.raw_id=f.raw_id where f.assertion_id not in (select assertion_id from cand) and len(list_intersect(fw,sw))>0),
 rk as (select *, row_number() over (partition by assertion_id order by s desc, o desc, unit_id desc) rn from sc), b1 as (select * from rk where rn=1), b2 as (select * from rk where rn=2)
select f.raw_id, f.assertion_id, case when c.n=1 then c.u when b1.s>=0.5 and (b2.s is null or b1.s>b2.s or (b1.s=b2.s and b1.o>b2.o)) then b1.unit_id end as unit_id from fa f left join cand c using (assertion_id) left join b1 using (assertion_id) left join b2 using (assertion_id)""")
def _(t):
    f = b.facts(t)
    cid = F.concat(F.lit("c"), F.floor((F.col("ord") + 1) / 2))
    units = f.select("raw_id", cid.alias("clause_id"), F.concat(F.lit("u"), "ord").alias("unit_id"), F.col("retrieval_text").alias("span"), F.lit("ASSERTED").alias("status"))
    facts = f.select("raw_id", "assertion_id", F.when(F.col("ord") % 2 == 0, F.array(cid)).otherwise(F.array().cast("array<string>")).alias("clause_ids"), F.col("retrieval_text").alias("text"))
    return cp.recover_links(facts, units).select("raw_id", "assertion_id", "unit_id")


_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_SPLIT = f"""with recursive c as (select doc_id::varchar raw_id, coalesce(text,'') as text, greatest(1000, 1500-2-64) room from documents),
 paras as (select raw_id, room, generate_subscripts(p,1) po, unnest(p) para from (select raw_id, room, list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda x: trim(x, {_TRIM})), lambda x: x<>'') p from c where length(text)>room)),
 sents as (select raw_id, room, po, generate_subscripts(s,1) so, unnest(s) s from (select raw_id, room, po, list_filter(list_transform(string_split(regexp_replace(para, '([.!?。！？])(\\s+[A-Z0-9"“(])', '\\1'||chr(1)||'\\2', 'g'), chr(1)), lambda x: trim(x, {_TRIM})), lambda x: x<>'') s from paras)),
 num as materialized (select *, row_number() over (partition by raw_id order by po, so) i from sents),
 -- a step takes the next sentence, or cuts the pending one; what a step gives out stands in done
 st as (select raw_id, room, 0 i, 0 step, 0 po, null::varchar held, null::varchar pend, []::varchar[] done from (select distinct raw_id, room from num)
  union all (select raw_id, room, i, step+1, po, case when cut>0 or pend is null then null else pend end, case when cut>0 then ltrim(pend[cut+1:], {_TRIM}) end, case when cut>0 then [rtrim(pend[1:cut], {_TRIM})] else [] end
   from (select *, case when length(pend)>room then case when sp>=greatest(200, room//2) then sp else room end else 0 end cut from (select *, length(regexp_extract(pend[1:room], '(?s)^(.*) ', 1)) sp from st where pend is not null))
  union all select st.raw_id, st.room, n.i, step+1, n.po, case when held is not null and n.po=st.po and length(held)+1+length(n.s)<=st.room then held||' '||n.s end,
   case when held is not null and n.po=st.po and length(held)+1+length(n.s)<=st.room then null else n.s end, case when held is not null and not (n.po=st.po and length(held)+1+length(n.s)<=st.room) then [held] else [] end
   from st join num n on n.raw_id=st.raw_id and n.i=st.i+1 where pend is null)),
 ends as (select raw_id, max(step) step from st group by 1),
 parts as (select raw_id, step, 0 k, unnest(done) as text from st union all select st.raw_id, st.step, 1, held from st join ends using (raw_id, step) where held is not null)
select raw_id, 'c1' as clause_id, text, null::varchar as parent_clause_id from c where length(text)<=room
union all select raw_id, 'c1::part'||row_number() over (partition by raw_id order by step, k), text, 'c1' from parts"""


@plan("txt_split_oversize", _SPLIT)
def _(t):
    c = t.documents.select(F.col("doc_id").cast("string").alias("raw_id"), F.lit("c1").alias("clause_id"), "text")
    return pk.split_oversize(c, 1500)


_PACK = """walk as (with recursive r as (select conversation_id, pos, {cost} c, row_number() over (partition by conversation_id order by pos) n from turns),
  g as (select conversation_id, n, pos, 0 chunk, c load from r where n=1 union all select r.conversation_id, r.n, r.pos, case when load>0 and load+c>{budget} then chunk+1 else chunk end, case when load>0 and load+c>{budget} then c else load+c end from g join r on r.conversation_id=g.conversation_id and r.n=g.n+1) select * from g)"""


@plan("cmp_pages", f"with {b.TURNS}, {_PACK.format(cost=k.count_tokens('text'), budget=100)} select conversation_id, pos, chunk::bigint as page from walk")
def _(t):
    return pk.paginate(b.turns(t), 100).select("conversation_id", "pos", "page")


@plan("cmp_line_chunks", f"with {b.TURNS}, {_PACK.format(cost=k.count_tokens('text'), budget=60)} select conversation_id, pos, chunk::bigint as chunk from walk")
def _(t):
    return pk.line_chunks(b.turns(t), 60).select("conversation_id", "pos", "chunk")


@plan("cmp_clause_chunks", f"""with recursive {b.TURNS}, {b.FACTS}, r as materialized (select conversation_id, session_id, pos*1000+ord pos, length(retrieval_text)+length(assertion_id)+32 c, row_number() over (partition by conversation_id, session_id order by pos, ord) n from facts),
 g as (select conversation_id, session_id, n, pos, 0 chunk, c load from r where n=1
  union all select r.conversation_id, r.session_id, r.n, r.pos, case when load>0 and load+c>400 then chunk+1 else chunk end, case when load>0 and load+c>400 then c else load+c end from g join r on r.conversation_id=g.conversation_id and r.session_id=g.session_id and r.n=g.n+1)
select conversation_id, session_id, pos, chunk::bigint as chunk from g""")
def _(t):
    # ordered by turn and sentence: from the thousandth sentence on, pos runs into the next turn's
    c = b.facts(t).withColumn("at", F.col("pos") * (1 << 20) + F.col("ord")).withColumn("pos", F.col("pos") * 1000 + F.col("ord")).select(
        "conversation_id", "session_id", "pos", "at", F.col("assertion_id").alias("clause_id"), F.col("retrieval_text").alias("text"))
    return pk.clause_chunks(c, 400, "at", 1 << 20).select("conversation_id", "session_id", "pos", "chunk")
