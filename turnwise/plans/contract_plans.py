"""Queries for validation, repair and decision rules. Responses are built from the tables, with breakage by modulus."""
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts as ct
from . import bindings as b, sqlkit as k
from .registry import plan

NONE = lambda ty="array<string>": F.array().cast(ty)


@plan("ctr_query_frame", """select o_orderkey::varchar as sample_id, array_to_string(list_sort(list_filter([case when o_orderkey%11=0 then 'IDENTITY_DRIFT' end, case when o_orderkey%7=0 then 'ENUM_RELATION_FAMILY' end, case when o_orderpriority='5-LOW' then 'ENUM_POLARITY' end,
 case when o_orderkey%3=0 then 'LIST_ENUM_REQUIRED_ROLES' end], lambda x: x is not null)),',') as errors, case when o_orderkey%3=0 then 'SUBJECT,HERO' else 'TIME_OWNER' end as roles from orders""")
def _(t):
    o = F.col("o_orderkey")
    js = F.when(o % 3 == 0, '{"r":["SUBJECT","HERO"]}').otherwise('{"r":"TIME"}')
    f = t.orders.select(o.cast("string").alias("sample_id"), F.when(o % 11 == 0, "x").otherwise(o.cast("string")).alias("source_sample_id"), F.lit("q").alias("question"), F.lit("q").alias("source_question"),
                        F.when(o % 7 == 0, "ODD").otherwise("TIME").alias("relation_family"), F.lit("COUNT").alias("answer_type"), F.lit("TEMPORAL_SEQUENCE").alias("evidence_shape"),
                        F.when(F.col("o_orderpriority") == "5-LOW", "MAYBE").otherwise("POSITIVE").alias("polarity_constraint"), F.lit("ANY").alias("modality_constraint"),
                        ct.list_or_scalar(js, "$.r").alias("required_roles"), F.array(F.lit("DIRECT_ONLY")).alias("allowed_inference"))
    return ct.validate_frames(f).select("sample_id", F.array_join("errors", ",").alias("errors"), F.array_join("required_roles", ",").alias("roles"))


@plan("ctr_query_plan", """select o_orderkey as sample_id, case when o_orderkey%5 in (0,1,2) then 'UNCERTAIN' else 'VALIDATED' end as status, case o_orderkey%5 when 0 then 'QUERY_KIND_ENUM' when 1 then 'EMPTY_TEMPORAL_QUERIES' when 2 then 'EMPTY_VALUE_QUERIES,KEY_CONTRACT,TYPE_VALUE_QUERIES' else '' end as errors from orders""")
def _(t):
    m = F.col("o_orderkey") % 5
    lst = lambda n, body='["x"]': f'"{n}":{body}'
    fixed = ",".join(lst(n) for n in ct.PLAN_LISTS if n not in ("value_queries", "temporal_queries"))
    kind = F.when(m == 0, "WHAT").when(m == 1, "TEMPORAL").otherwise("SINGLE_FACT")
    val = F.when(m == 2, "").otherwise(lst("value_queries") + ",")
    tq = F.when(m == 1, "[]").otherwise('["when"]')
    reply = F.concat(F.lit('{"query_kind":"'), kind, F.lit('",'), val, F.lit('"temporal_queries":'), tq, F.lit(f',{fixed},"polarity":"UNKNOWN","modality":"ACTUAL"}}'))
    p = ct.validate_plans(t.orders.select(F.col("o_orderkey").alias("sample_id"), reply.alias("reply")))
    return p.select("sample_id", "status", F.array_join("errors", ",").alias("errors"))


# -- memory responses: one per turn, broken in known ways -------------------

def responses(t):
    """JSON memory replies of the turns: clause c1 holds the text; facts and links break by position."""
    p = F.col("pos")
    fact = F.concat(
        F.lit('{"assertion_id":"a1","subject":"'), F.col("speaker"), F.lit('","relation_family":"'), F.when(p % 3 == 0, "ODD").otherwise("TIME"), F.lit('","surface_relation":"said","answer_value":{"type":"'),
        F.when(p % 4 == 1, "THING").otherwise("COUNT"), F.lit('","value":"'), F.when(p % 5 == 4, "").otherwise(p.cast("string")),
        F.lit('"},"roles":{},"modality":"PLANNED","polarity":"POSITIVE","scope":{},"retrieval_text":"said it","provenance":{"raw_ids":["'), F.col("raw_id"), F.lit('"],"clause_ids":["c1"],"unit_ids":["u1"]}}'))
    unit = F.when(p % 2 == 0, F.concat(F.lit('{"unit_id":"u1","span":"x","status":"'), F.when(p % 6 == 2, "WEIRD").otherwise("ASSERTED"), F.lit('","assertion_ids":["a1"]}'))).otherwise("")
    cu = F.concat(F.lit('[{"clause_id":"c1","units":['), unit, F.lit("]}]"))
    ment = F.when(p % 7 == 3, '[{"text":"x","role":"KING","clause_id":"zz"}]').otherwise("[]")
    reply = F.concat(F.lit('{"center_raw_id":"'), F.col("raw_id"), F.lit('","l1":{"clause_units":'), cu, F.lit(',"mentions":'), ment, F.lit('},"l2_direct":['), fact, F.lit("]}"))
    clauses = F.array(F.struct(F.lit("c1").alias("clause_id"), F.col("text").alias("text")))
    return b.turns(t).select("raw_id", "pos", clauses.alias("clauses"), reply.alias("reply"))


@plan("ctr_shape_repair", f"""with {b.TURNS}, x as (select *, pos%5=4 as gone from turns) select raw_id, array_to_string(list_sort(list_filter([case when pos%2=1 then 'inserted_unresolved_unit' end, case when pos%6=2 then 'normalized_unit_status' end, case when pos%3=0 then 'normalized_relation_family' end,
 case when pos%4=1 then 'normalized_answer_type' end, case when gone then 'dropped_incomplete_assertion' end, case when gone and pos%2=0 then 'downgraded_unlinked_asserted_unit' end, case when not gone and pos%2=1 then 'reconstructed_unit_from_assertion_provenance' end,
 case when pos%7=3 then 'normalized_mention_provenance' end, case when pos%7=3 then 'normalized_mention_role' end], lambda r: r is not null)),',') as repairs, case when gone then 0 else 1 end as n_facts, case when gone then 'UNRESOLVED' else 'ASSERTED' end as unit_status, case when gone then '' else 'a1' end as unit_links from x""")
def _(t):
    r = ct.repair_memory(ct.read_memory(responses(t)))
    u = F.element_at(F.element_at("memory.l1.clause_units", 1)["units"], 1)
    return r.select("raw_id", F.array_join("repairs", ",").alias("repairs"), F.size("memory.l2_direct").alias("n_facts"), u["status"].alias("unit_status"), F.array_join(u["assertion_ids"], ",").alias("unit_links"))


@plan("ctr_adapt_shape", f"""with {b.TURNS} select raw_id, 'c1' as clause_id, 'u1' as unit_id, case when pos%2=0 then 'ASSERTED' else 'NON_PROPOSITIONAL' end as status, case when pos%2=0 then 'a1' else '' end as assertion_ids, case when pos%3=0 then 'OTHER' else 'COUNT' end as answer_type,
 case when pos%4=0 then 'OTHER' else 'said' end as relation, speaker||' '||case when pos%4=0 then 'OTHER' else 'said' end||' '||pos as retrieval_text from turns""")
def _(t):
    p, s = F.col("pos"), lambda v, n: F.lit(v).cast("string").alias(n)
    a = F.array(F.struct(s(None, "assertion_id"), F.col("speaker").alias("subject"), s(None, "relation_family"), F.when(p % 4 != 0, "said").alias("surface_relation"), F.when(p % 3 == 0, "THING").otherwise("COUNT").alias("answer_type"),
                         p.cast("string").alias("value"), s(None, "role"), F.array(F.when(p % 2 == 0, "c1").otherwise("c9")).alias("clause_ids"), s(None, "time"), s(None, "modality"), s(None, "polarity")))
    r = ct.adapt_memory(b.turns(t).select("raw_id", F.array(F.struct(F.lit("c1").alias("clause_id"), F.col("text").alias("text"))).alias("clauses"), a.alias("assertions")))
    u, f = F.element_at("units", 1), F.element_at("facts", 1)
    return r.select("raw_id", u["clause_id"].alias("clause_id"), u["unit_id"].alias("unit_id"), u["status"].alias("status"), F.array_join(u["assertion_ids"], ",").alias("assertion_ids"), f["answer_value"]["type"].alias("answer_type"),
                    f["surface_relation"].alias("relation"), f["retrieval_text"].alias("retrieval_text"))


@plan("ctr_clause_coverage", """select o_orderkey as raw_id, (o_orderkey%4=0)::int::bigint as missing, (o_orderkey%5=0)::int::bigint as foreign_n, (o_orderkey%6=0)::int::bigint as repeated, (o_orderkey%7=0 and o_orderkey%4<>0)::int::bigint as empty_n, (o_orderkey%9=0)::int::bigint as bad_status from orders""")
def _(t):
    o = F.col("o_orderkey")
    e = lambda c, n, st: F.struct(F.lit(c).alias("clause_id"), F.lit(n).alias("entry"), st.alias("status"))
    ok = F.lit("ASSERTED")
    rows = F.array_compact(F.array(F.when(o % 4 != 0, e("c1", 1, F.when(o % 7 != 0, ok))), e("c2", 2, F.when(o % 9 == 0, "ODD").otherwise("UNRESOLVED")), F.when(o % 6 == 0, e("c2", 3, ok)), F.when(o % 5 == 0, e("zz", 4, ok))))
    units = t.orders.select(o.alias("raw_id"), F.explode(rows).alias("x")).select("raw_id", "x.*")
    clauses = t.orders.select(o.alias("raw_id"), F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("clause_id"))
    return ct.clause_coverage(units, clauses).select("raw_id", "missing", F.col("foreign").alias("foreign_n"), "repeated", F.col("empty").alias("empty_n"), "bad_status")


@plan("ctr_link_integrity", """select raw_id, item, violation from (select o_orderkey::varchar raw_id, 'u1' item, 'unit_span_empty' violation from orders where o_orderkey%5=0 union all select o_orderkey::varchar, 'u1', 'unit_span_is_range' from orders where o_orderkey%5=1
 union all select o_orderkey::varchar, 'u1', 'asserted_unit_without_assertion' from orders where o_orderkey%3=0 union all select o_orderkey::varchar, o_orderkey||'::l2::1', 'link_mismatch' from orders where o_orderkey%3=0
 union all select o_orderkey::varchar, o_orderkey||'::l2::1', 'assertion_unit_clause_mismatch' from orders where o_orderkey%4=0 union all select o_orderkey::varchar, o_orderkey||'::l2::2', 'assertion_missing_unit_ids' from orders where o_orderkey%7=0)""")
def _(t):
    o, rid = F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("raw_id")
    u = t.orders.select(rid, F.lit("c1").alias("clause_id"), F.lit("u1").alias("unit_id"), F.lit("ASSERTED").alias("status"), F.when(o % 5 == 0, " ").when(o % 5 == 1, "3 - 9").otherwise("span").alias("span"),
                        F.when(o % 3 == 0, NONE()).otherwise(F.array(F.lit("a1"))).alias("assertion_ids"))
    f1 = t.orders.select(rid, F.lit(1).alias("ord"), F.lit("a1").alias("assertion_id"), F.array(F.when(o % 4 == 0, "c2").otherwise("c1")).alias("clause_ids"), F.array(F.lit("u1"), F.lit("stale")).alias("unit_ids"))
    f2 = t.orders.where(o % 7 == 0).select(rid, F.lit(2).alias("ord"), F.lit("a2").alias("assertion_id"), F.array(F.lit("c1")).alias("clause_ids"), NONE().alias("unit_ids"))
    return ct.link_integrity(f1.unionByName(f2), u)


ACT = "array<struct<act:string,antecedent_raw_ids:array<string>,resolved_proposition:struct<source_raw_ids:array<string>>>>"


def _contextual(t):
    p, rid = F.col("pos"), F.col("raw_id")
    link = F.struct(F.when(p % 4 == 3, F.array(F.lit("far"))).otherwise(F.array(F.lit("n1"))).alias("antecedent_raw_ids"))
    act = F.struct(F.when(p % 5 == 2, "CONFIRMATION").when(p % 5 == 3, "SHOUT").otherwise("ASSERTION").alias("act"), F.when(p % 3 == 0, F.array(rid)).otherwise(NONE()).alias("antecedent_raw_ids"),
                   F.when(p % 2 == 1, F.struct(F.when(p % 7 == 5, F.array(F.lit("n1"))).otherwise(F.array(rid, F.lit("n1"))).alias("source_raw_ids"))).alias("resolved_proposition"))
    return b.turns(t).select("raw_id", "pos", F.array(F.lit("n1"), F.lit("n2")).alias("supplied"), F.when(p % 6 == 1, "QUESTION").otherwise("NONE").alias("context_dependency"),
                             F.when(p % 3 == 0, F.array(rid, F.lit("n1"))).otherwise(F.array(F.lit("n1"))).alias("antecedent_raw_ids"), F.array(act).cast(ACT).alias("speech_acts"), F.array(link).alias("occurrence_links"))


@plan("ctr_contextual", f"""with {b.TURNS}, e as (select raw_id, pos, list_sort(list_distinct(list_filter([case when pos%6=1 then 'CONTEXT_DEPENDENCY_ENUM' end, case when pos%3=0 then 'INVALID_ANTECEDENT' end, case when pos%5=3 then 'ACT_0_ENUM' end, case when pos%3=0 then 'ACT_0_ANTECEDENT' end,
  case when pos%5=2 and pos%3<>0 then 'ACT_0_MISSING_ANTECEDENT' end, case when pos%2=1 and pos%7=5 then 'ACT_0_SOURCES' end, case when pos%4=3 then 'OCCURRENCE_0_ANTECEDENT' end], lambda x: x is not null))) l,
  list_sort(list_filter([case when pos%5=3 then 'ACT_0_ENUM' end, case when pos%5=2 then 'ACT_0_MISSING_ANTECEDENT' end, case when pos%2=1 and pos%7=5 then 'ACT_0_SOURCES' end], lambda x: x is not null)) n from turns)
select raw_id, array_to_string(l,',') as errors, array_to_string(n,',') as errors_after from e""")
def _(t):
    c = _contextual(t)
    a = ct.validate_contextual(c).select("raw_id", F.array_join("errors", ",").alias("errors"))
    return a.join(ct.validate_contextual(ct.normalize_contextual(c)).select("raw_id", F.array_join("errors", ",").alias("errors_after")), "raw_id")


@plan("ctr_merge_contract", """select c_nationkey as conversation_id, c_custkey::varchar as item, 'unknown_old_assertion' as violation from customer where c_custkey%6=0 union all select c_nationkey, c_custkey::varchar, 'unknown_supersession_source' from customer where c_custkey%9=0
union all select c_nationkey, c_name, 'bad_status' from customer where c_custkey%8=0 union all select c_nationkey, c_name, 'unknown_assertion_source' from customer where c_custkey%10=0""")
def _(t):
    c, conv = F.col("c_custkey"), F.col("c_nationkey").alias("conversation_id")
    sup = t.customer.select(conv, c.cast("string").alias("old_assertion_id"), F.array(F.when(c % 9 == 0, "lost").otherwise(F.concat(F.lit("r"), c))).alias("source_raw_ids"))
    mer = t.customer.select(conv, F.col("c_name").alias("assertion_id"), F.when(c % 8 == 0, "GONE").otherwise("CURRENT").alias("status"), F.array(F.when(c % 10 == 0, "lost").otherwise(F.concat(F.lit("r"), c))).alias("source_raw_ids"))
    return ct.validate_merge(sup, mer, t.customer.where(c % 6 != 0).select(conv, c.cast("string").alias("assertion_id")), t.customer.select(conv, F.concat(F.lit("r"), c).alias("raw_id")))


@plan("ctr_category_cover", """with it as (select n_regionkey scope, n_nationkey idx, n_name nm from nation), pr as (select r_regionkey scope, 1 ord, r_name nm, (select list(n_nationkey) from nation where n_regionkey=r_regionkey and n_nationkey%2=0) m from region)
select i.scope, p.nm as category, i.idx, false as singleton from it i join pr p on p.scope=i.scope and list_contains(p.m, i.idx) union all select scope, case when idx%5=1 then 'Speaker' else nm end, idx, true from it where idx%2=1""")
def _(t):
    items = t.nation.select(F.col("n_regionkey").alias("scope"), F.col("n_nationkey").alias("idx"), F.when(F.col("n_nationkey") % 10 == 1, "I").otherwise(F.when(F.col("n_nationkey") % 5 == 1, "user").otherwise(F.col("n_name"))).alias("name"))
    m = t.nation.groupBy(F.col("n_regionkey").alias("scope")).agg(F.collect_list("n_nationkey").alias("all"))
    base = t.region.join(m, F.col("scope") == F.col("r_regionkey"))
    even = F.concat(F.filter("all", lambda x: x % 2 == 0), F.array(F.lit(99), F.lit(-1)))
    prop = lambda o, n, mem: base.select("scope", F.lit(o).alias("ord"), n.alias("name"), mem.alias("members"))
    p = prop(1, F.col("r_name"), even).unionByName(prop(2, F.lower("r_name"), F.col("all"))).unionByName(prop(3, F.lit("this and that"), F.col("all"))).unionByName(prop(4, F.lit(" Other "), F.col("all"))).unionByName(prop(5, F.lit("far"), F.array(F.lit(500))))
    return ct.category_cover(items, p, 2)


# -- citations, claims, checks ---------------------------------------------

_CITE = f"""cit as (select q.sample_id, 1 claim_no, c, case c when 1 then q.sample_id else coalesce(g.raw_id,'none') end raw_id, case when c=1 then {k.norm('q.query_text')} else 'photo of '||q.sample_id end quote from questions q left join gold g using (sample_id), (values (1),(2)) v(c)),
 val as (select *, raw_id=sample_id and trim(quote)<>'' and c=1 as valid from cit)"""


def _citations(t):
    q = b.questions(t).join(b.gold(t).select("sample_id", F.col("raw_id").alias("g")), "sample_id", "left")
    c = q.select("sample_id", F.lit(1).alias("claim_no"), F.explode(F.array(F.struct(F.lit(1).alias("c"), F.col("sample_id").alias("raw_id"), tx.normalize_text("query_text").alias("quote")),
                                                                          F.struct(F.lit(2).alias("c"), F.coalesce("g", F.lit("none")).alias("raw_id"), F.concat(F.lit("photo of "), "sample_id").alias("quote")))).alias("x")).select("sample_id", "claim_no", "x.*")
    packet = b.questions(t).select("sample_id", F.col("sample_id").alias("raw_id"), F.col("query_text").alias("original_text"), F.lit("").alias("image_caption"))
    return ct.valid_citations(c, packet)


@plan("ctr_citations", f"with {b.QUESTIONS}, {_CITE} select sample_id, c, raw_id, valid from val")
def _(t):
    return _citations(t).select("sample_id", "c", "raw_id", "valid")


@plan("ctr_claims", f"""with {b.QUESTIONS}, {_CITE}, cl as (select sample_id, pos, case when pos%4=0 then 'on 7 May' else 'fine' end claim, case when pos%4=2 then 'DERIVED' else 'DIRECT' end st, case when pos%8=2 then 'because' else '' end dv, pos%6=0 as both_cites from questions),
 n as (select v.sample_id, count(*) n, count(*) filter (valid) nv, string_agg(case when valid then quote end,' ') qs from val v join cl using (sample_id) where both_cites or c=1 group by 1)
select sample_id, coalesce(nv,0)::bigint as n_valid, n=nv and nv>0 and (st='DIRECT' or dv<>'') and (st<>'DIRECT' or claim='fine' or (list_contains(regexp_extract_all(lower(qs),'[a-z]+|[0-9]+'),'7') and list_contains(regexp_extract_all(lower(qs),'[a-z]+|[0-9]+'),'may'))) as citations_valid from cl join n using (sample_id)""")
def _(t):
    p = F.col("pos")
    cl = b.questions(t).select("sample_id", "pos", F.lit(1).alias("claim_no"), F.when(p % 4 == 0, "on 7 May").otherwise("fine").alias("claim"), F.when(p % 4 == 2, "DERIVED").otherwise("DIRECT").alias("support_type"),
                               F.when(p % 8 == 2, "because").otherwise("").alias("derivation"))
    c = _citations(t).join(cl.select("sample_id", "pos"), "sample_id").where((p % 6 == 0) | (F.col("c") == 1)).drop("pos")
    return ct.validate_claims(cl, c).select("sample_id", "n_valid", "citations_valid")


def _checks(t):
    o = F.col("o_orderkey")
    req = F.struct(F.lit("n").alias("need"), F.when(o % 4 == 1, "ODD").otherwise("SUPPORTED").alias("status"), F.lit(1).cast("bigint").alias("n_citations"), (o % 2).cast("bigint").alias("n_valid"))
    gap = lambda i, ok: F.struct(F.lit(f"g{i}").alias("gap_id"), F.lit("find it").alias("retrieval_query"), ok.alias("retrievable"))
    return t.orders.select(o.alias("sample_id"), F.lit("Who?").alias("question"), F.when(o % 3 == 0, "UNSUPPORTED").otherwise("SUPPORTED").alias("answer_support"), F.lit("COMPLETE").alias("requirement_coverage"),
                           F.lit("ALIGNED").alias("target_alignment"), F.when(o % 5 < 2, "KEEP").when(o % 5 == 2, "RETRIEVE").otherwise("USE_REVISED").alias("decision"), F.array(req).alias("requirements"),
                           F.when(o % 7 == 0, F.array(gap(1, F.lit(True)), gap(2, F.lit(False)), gap(3, F.lit(True)))).otherwise(F.array().cast("array<struct<gap_id:string,retrieval_query:string,retrievable:boolean>>")).alias("gaps"),
                           F.array(F.lit("g1"), F.lit("g9")).alias("resolved_gaps"), F.array(F.lit("g1")).alias("prior_gap_ids"), (o % 11 == 0).cast("int").alias("n_invalid_claims"))


_CHECK = """chk as (select o_orderkey o, case when o_orderkey%5<2 then 'KEEP' when o_orderkey%5=2 then 'RETRIEVE' else 'USE_REVISED' end d0, o_orderkey%7=0 hg, o_orderkey%3=0 uns, o_orderkey%11=0 inv from orders),
 ch1 as (select *, case when d0='RETRIEVE' and not hg then 'REJECT_UNSUPPORTED' when d0='KEEP' and uns then 'REJECT_UNSUPPORTED' else d0 end d2 from chk), ch2 as (select *, inv and d2 in ('KEEP','USE_REVISED') unc from ch1)"""


@plan("ctr_check_downgrade", f"""with {_CHECK} select o as sample_id, case when unc then 'RETRIEVE' else d2 end as decision, case when unc then 'UNSUPPORTED' when uns then 'UNSUPPORTED' else 'SUPPORTED' end as answer_support, case when unc then 'INCOMPLETE' else 'COMPLETE' end as coverage,
 case when o%4=1 then 'UNCERTAIN' when o%2=0 then 'UNCERTAIN' else 'SUPPORTED' end as requirement, case when hg then 'g1' when unc then 'certificate_support' else '' end as gap_ids, array_to_string(list_sort(list_filter([case when o%4=1 then 'invalid_requirement' end, case when o%4=1 then 'requirements_fallback' end,
 case when o%4<>1 and o%2=0 then 'invalid_citation' end, case when o%4<>1 and o%2=0 then 'unsupported_support_claim' end, case when hg then 'gap_truncated' end, case when d0='RETRIEVE' and not hg then 'retrieve_without_actionable_gap' end, case when d0='KEEP' and uns then 'invalid_keep_downgrade' end,
 case when unc then 'answer_certificate_invalid' end], lambda x: x is not null)),',') as issues from ch2""")
def _(t):
    r = ct.normalize_check(_checks(t))
    return r.select("sample_id", "decision", "answer_support", F.col("requirement_coverage").alias("coverage"), F.element_at("requirements", 1)["status"].alias("requirement"),
                    F.array_join(F.transform("gaps", lambda g: g["gap_id"]), ",").alias("gap_ids"), F.array_join("issues", ",").alias("issues"))


@plan("ctr_trigger", f"with {_CHECK} select o as sample_id, case when unc then true else d2='RETRIEVE' and hg end as retrieve from ch2")
def _(t):
    return ct.should_retrieve(ct.normalize_check(_checks(t))).select("sample_id", "retrieve")


@plan("ctr_select_answer", """with s as (select o_orderkey o from orders), r as (select o, case when o%2=1 then 'no_qualified_new_evidence' when o%3=0 then 'revision_not_verified' when o%5=0 then 'revision_target_or_conflict' when o%7=0 then 'revision_incomplete' when o%11=0 then 'revision_citations_invalid'
 when o%13=0 then 'revision_has_no_new_support' when o%17=0 then 'no_resolved_gap' else 'verified_revision' end reason from s) select o as sample_id, reason as selection_reason, case when reason='verified_revision' then 'new' else 'old' end as final_answer from r""")
def _(t):
    o = F.col("o_orderkey")
    claims = F.array(F.struct((o % 11 != 0).alias("citations_valid"), F.when(o % 13 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("n"))).alias("raw_ids")))
    d = t.orders.select(o.alias("sample_id"), F.lit("old").alias("direct"), F.lit("new").alias("revised"), F.when(o % 3 == 0, "KEEP").otherwise("USE_REVISED").alias("decision"), F.lit("SUPPORTED").alias("answer_support"),
                        F.lit("ALIGNED").alias("target_alignment"), F.when(o % 5 == 0, "CONFLICT").otherwise("NONE").alias("conflict_status"), F.when(o % 7 == 0, "INCOMPLETE").otherwise("COMPLETE").alias("requirement_coverage"),
                        claims.alias("claims"), F.when(o % 2 == 1, NONE()).otherwise(F.array(F.lit("n"))).alias("added"), F.when(o % 17 == 0, NONE()).otherwise(F.array(F.lit("g1"))).alias("resolved_gaps"))
    return ct.select_answer(d).select("sample_id", "selection_reason", "final_answer")


@plan("ctr_auto_verdict", f"""with {b.JUDGED}, x as (select sample_id, system, category, case when sample_id::int%4=0 then '' else lower(split_part(text,'.',1)) end g, case when sample_id::int%3=0 then 'Not enough information.' else text end p from judged), n as (select *, {k.norm_answer('g')} ng, {k.norm_answer('p')} np_ from x)
select sample_id, case when category='5' and ng='' and np_='not enough information' then 'auto_empty_answer' when np_<>'' and ng<>'' and contains(np_,ng) then 'auto_strict' else 'judge' end as verdict_source from n""")
def _(t):
    i = F.col("sample_id").cast("int")
    g = F.when(i % 4 == 0, "").otherwise(F.lower(F.substring_index("text", ".", 1)))
    r = b.judged(t).select("sample_id", F.col("category").alias("question_type"), g.alias("gold_answer"), F.array(g).alias("candidates"), F.when(i % 3 == 0, "Not enough information.").otherwise(F.col("text")).alias("pred_answer"))
    return ct.auto_verdict(r).select("sample_id", "verdict_source")


_OK = "o_orderkey%3<>0"


@plan("ctr_promote", f"""with old as (select o_orderkey idx from orders where o_orderkey%2=0) select o_orderkey as idx, 'CONTENT_VALIDATED_PERMANENT' as status, case when {_OK} then sha256(o_orderpriority) else 'old' end as content_sha256, case when {_OK} then case when o_orderkey%5=0 then 'normalized_roles,normalized_scope' else '' end else '' end as repairs
 from orders where {_OK} or o_orderkey%2=0""")
def _(t):
    o = F.col("o_orderkey")
    rep = F.array_compact(F.array(F.when(o % 3 == 0, "dropped_malformed_unit"), F.when(o % 5 == 0, "normalized_scope"), F.when(o % 5 == 0, "normalized_roles")))
    d = t.orders.select(o.alias("idx"), o.cast("string").alias("raw_id"), F.col("o_orderpriority").alias("content"), rep.alias("repairs"))
    m = t.orders.where(o % 2 == 0).select(o.alias("idx"), o.cast("string").alias("raw_id"), F.lit("old").alias("content_sha256"), F.lit("CONTENT_VALIDATED_PERMANENT").alias("status"), F.lit("").alias("repairs"))
    return ct.promote(d, m).select("idx", "status", "content_sha256", "repairs")


@plan("ctr_revoke", """select c_custkey as idx, case when c_custkey%9=0 and c_custkey%2=0 then 'SUPERSEDED' when c_custkey%2=0 then 'CONTENT_VALIDATED_PERMANENT' else 'DRAFT' end as status, case when c_custkey%9=0 and c_custkey%2=0 then '2024-01-01T00:00:00Z' end as superseded_at, c_custkey%9=0 and c_custkey%2=0 as in_history from customer""")
def _(t):
    c = F.col("c_custkey")
    m = t.customer.select(c.alias("idx"), F.col("c_name").alias("content_sha256"), F.when(c % 2 == 0, "CONTENT_VALIDATED_PERMANENT").otherwise("DRAFT").alias("status"))
    new, hist = ct.revoke(m, t.customer.where(c % 9 == 0).select(c.alias("idx"), F.lit("stale").alias("reason")), "2024-01-01T00:00:00Z")
    return new.join(hist.select("idx", F.lit(True).alias("h")), "idx", "left").select("idx", "status", "superseded_at", F.coalesce("h", F.lit(False)).alias("in_history"))


@plan("ctr_cache_split", "select o_orderkey as sample_id, case when o_orderstatus='F' then 'hit' else 'miss' end as state, case when o_orderstatus='F' then 'r'||o_orderpriority end as response from orders")
def _(t):
    r = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.concat("o_orderstatus", "o_orderpriority").alias("payload"), F.lit("m1").alias("model"), F.lit("p").alias("prompt_sha"), F.lit("o").alias("ontology_sha"))
    from ..functions.text import content_key
    pr = t.orders.select("o_orderpriority").distinct()
    key = lambda st, model: content_key(payload=F.concat(F.lit(st), "o_orderpriority"), model=F.lit(model), prompt_sha=F.lit("p"), ontology_sha=F.lit("o")).alias("request_key")
    cache = pr.select(key("F", "m1"), F.concat(F.lit("r"), "o_orderpriority").alias("response")).unionByName(pr.select(key("O", "m0"), F.lit("stale").alias("response")))
    hits, misses = ct.split_cached(r, cache)
    return hits.select("sample_id", F.lit("hit").alias("state"), "response").unionByName(misses.select("sample_id", F.lit("miss").alias("state"), F.lit(None).cast("string").alias("response")))


@plan("ctr_missing_gold", "select 'count' as kind, null::bigint as sample_id, count(*)::bigint as n from orders where o_orderkey%6=0 union all select 'example', sample_id, null from (select o_orderkey sample_id from orders where o_orderkey%6=0 order by 1 limit 20)")
def _(t):
    o = F.col("o_orderkey")
    n, ex = ct.missing_gold(t.orders.select(o.alias("sample_id"), F.when(o % 6 == 0, "  ").otherwise("x").alias("gold_answer")))
    return n.select(F.lit("count").alias("kind"), F.lit(None).cast("bigint").alias("sample_id"), F.col("n_missing").alias("n")).unionByName(ex.select(F.lit("example").alias("kind"), "sample_id", F.lit(None).cast("bigint").alias("n")))
