"""Queries for fusion, quotas, packets and prompts."""
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as cp, fusion as fu
from . import bindings as b, sqlkit as k
from .corpus_plans import _GIST
from .registry import plan

_L = f"with {b.LANES}, l as (select * from lanes where rank<=128)"
_BEST = "fam as (select sample_id, family, raw_id, min(rank) rank from l group by 1,2,3)"


@plan("fus_best_rank", f"{_L}, {_BEST} select * from fam")
def _(t):
    return fu.collapse_best(b.lanes(t))


@plan("fus_family_rrf", f"""{_L}, s as (select sample_id, family, raw_id, round(sum(1/(20+rank)),9) s from l group by 1,2,3)
select sample_id, family, raw_id, rank from (select *, row_number() over (partition by sample_id, family order by s desc, raw_id)::bigint rank from s) where rank<=128""")
def _(t):
    return fu.family_rrf(b.lanes(t))


def _arm_sql(expr):
    return f"""{_L}, {_BEST}, g as (select sample_id, raw_id, sum(1/(20+rank)) rrf, max(1/(20+rank)) best, sum((1/(20+rank))**2) sharp from fam group by 1,2), s as (select sample_id, raw_id, round({expr},9) score from g)
select sample_id, raw_id, score, rank from (select *, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from s) where rank<=128"""


def _arm(key, arm, expr):
    @plan(key, _arm_sql(expr))
    def _(t):
        return fu.fuse(fu.collapse_best(b.lanes(t)), arms=[arm]).drop("arm")


_arm("fus_rrf", "RRF_BASELINE", "rrf")
_arm("fus_combmax", "COMBMAX", "best")
_arm("fus_sharp_rrf", "SHARP_RRF_P2", "sharp")
_arm("fus_best_primary", "BEST_PRIMARY_L025", "best+0.25*(rrf-best)")

_FAKE = {"price_desc": "raw", "price_asc": "assertion", "newest": "proposition", "oldest": "entity", "priority": "graph"}


def _lex_lanes(t):
    table = F.create_map(*[F.lit(v) for kv in _FAKE.items() for v in kv])
    return b.lanes(t).select("sample_id", table[F.col("lane")].alias("lane"), "raw_id", "rank")


_SPEC = ", ".join(f"('{arm}', {i}, '{lane}', {n})" for arm, amounts in fu.QUOTAS.items() for i, (lane, n) in enumerate([*amounts, *[(x, 1) for x in fu.LANE_ORDER]]))
_NAMED = " ".join(f"when '{a}' then '{z}'" for a, z in _FAKE.items())


@plan("fus_quota", f"""with recursive {b.LANES}, spec(arm, i, lane, n) as (values {_SPEC}), ls as (select sample_id, case lane {_NAMED} end lane, list(raw_id order by rank) ids from lanes where rank<=128 group by 1,2),
 sz as (select sample_id, least(12, count(distinct raw_id)) size from lanes where rank<=128 group by 1),
 st as (select sample_id, arm, size, 0 step, []::varchar[] got from sz, (select distinct arm from spec)
  union all select st.sample_id, st.arm, size, step+1, list_concat(got, list_filter(coalesce(ids, []::varchar[]), lambda x: not list_contains(got, x))[1:least(n, size-len(got))])
  from st join spec on spec.arm=st.arm and spec.i=case when step<5 then step else 5+(step-5)%5 end left join ls on ls.sample_id=st.sample_id and ls.lane=spec.lane where step<65 and len(got)<size),
 fin as (select sample_id, arm, arg_max(got, step) got from st group by 1,2)
select sample_id, arm, unnest(got) as raw_id, generate_subscripts(got, 1)::bigint as rank from fin""")
def _(t):
    return fu.quota_fill(_lex_lanes(t), limit=12)


_STREAM = "st as (select sample_id, case family when 'price' then 1 when 'date' then 2 else 3 end layer, lane, raw_id, rank from l)"
_COLL = "coll as (select *, row_number() over (partition by sample_id, layer order by support desc, mass, best, raw_id)::bigint rank from (select sample_id, layer, raw_id, count(*) support, round(sum(1/(20+rank)),12) mass, min(rank) best from st group by 1,2,3))"


def _streams(t):
    return b.lanes(t).select("sample_id", F.when(F.col("family") == "price", 1).when(F.col("family") == "date", 2).otherwise(3).alias("layer"), F.col("lane").alias("stream"), "raw_id", "rank")


@plan("fus_layer_collapse", f"{_L}, {_STREAM}, {_COLL} select sample_id, layer, raw_id, rank from coll")
def _(t):
    return fu.layer_collapse(_streams(t)).select("sample_id", "layer", "raw_id", "rank")


@plan("fus_layer_consensus", f"""{_L}, {_STREAM}, {_COLL}, g as (select sample_id, raw_id, count(distinct layer) n, round(sum(1/(20+rank)),12) m from coll where rank<=192 group by 1,2)
select sample_id, raw_id, n::bigint as n_layers, row_number() over (partition by sample_id order by n desc, m desc, raw_id)::bigint as rank from g""")
def _(t):
    return fu.consensus(fu.layer_collapse(_streams(t))).select("sample_id", "raw_id", "n_layers", "rank")


@plan("fus_routed_budget")
def _(t):
    s = _streams(t)
    kinds = s.select("sample_id").distinct().withColumn("query_kind", F.element_at(F.array(*map(F.lit, ["SINGLE_FACT", "SET_COLLECTION", "MULTIHOP", "TEMPORAL"])), (F.pmod(F.crc32("sample_id"), F.lit(4)) + 1).cast("int")))
    o = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("x"), F.concat(F.lit("o"), F.col("o_orderkey") + 1).alias("y"))
    links = o.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(o.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    roles = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("raw_id"), (F.col("o_orderkey") % 6 == 0).alias("necessary"))
    return fu.routed_candidates(s, kinds, links, roles)


@plan("fus_topk_prefix", f"{_L} select k, sample_id, raw_id, rank from l, (values (10),(20)) x(k) where lane='newest' and rank<=k")
def _(t):
    return fu.prefix(b.lanes(t, ["newest"])).select("k", "sample_id", "raw_id", "rank")


_TOP = "top as (select q.sample_id, t.raw_id, (t.pos-q.pos+1)::bigint as rank from questions q join turns t on t.conversation_id=q.conversation_id and t.pos between q.pos and q.pos+2)"


def _near(t):
    """The question's turn and the two after it as its top three."""
    q = b.questions(t).select("sample_id", "conversation_id", F.col("pos").alias("q"))
    tt = b.turns(t).withColumn("q", F.explode(F.array("pos", F.col("pos") - 1, F.col("pos") - 2)))
    return q.join(tt, ["conversation_id", "q"]).select("sample_id", "raw_id", "conversation_id", (F.col("pos") - F.col("q") + 1).cast("bigint").alias("rank"), "turn_id", "text", "speaker")


@plan("fus_packet", f"""with {b.QUESTIONS}, {b.FACTS}, {_TOP}, m as (select raw_id, string_agg(retrieval_text, chr(10) order by ord) a from facts group by 1)
select sample_id, raw_id, rank, speaker, timestamp as source_timestamp, case when length(text)>120 then text[1:120]||chr(10)||'[raw session truncated by answer budget]' else text end as original_text, coalesce(a,'') as memory_assertions,
 case when idx=4 then 'a photo' else '' end as image_caption from top join turns using (raw_id) left join m using (raw_id)""")
def _(t):
    r = b.turns(t).select("raw_id", "speaker", "timestamp", F.col("text").alias("raw_text"), F.when(F.col("idx") == 4, "a photo").alias("image_caption"))
    return fu.packet(_near(t).select("sample_id", "raw_id", "rank"), r, b.facts(t), 120)


_LINE = f"'- [memory_id='||raw_id||'] '||{k.norm('t.text')}"


@plan("fus_prompt", f"""with {b.QUESTIONS}, {_TOP}, p as (select sample_id, string_agg({_LINE}, chr(10) order by rank) blk, string_agg(raw_id, ',' order by rank) ids from top join turns t using (raw_id) group by 1)
select q.sample_id, blk as memory_context, blk||chr(10)||chr(10)||'Question: '||q.query_text as full_prompt, ids as injected_entry_ids, len(regexp_extract_all(blk||chr(10)||'Question: '||q.query_text,'\\S+'))::bigint as token_count from questions q join p using (sample_id)""")
def _(t):
    lines = _near(t).select("sample_id", "rank", F.col("raw_id").alias("entry_id"), F.concat(F.lit("- [memory_id="), "raw_id", F.lit("] "), tx.normalize_text("text")).alias("line"))
    return fu.prompts(lines, b.questions(t).select("sample_id", F.col("query_text").alias("question")))


@plan("fus_prompt_sections", f"""with {b.QUESTIONS}, {_TOP}, i as (select sample_id, case when speaker='user' then 1 else 2 end section_no, speaker||' memories' title, case when rank=3 then 'system' else 'user' end target, rank, turn_id content from top join turns using (raw_id)),
 s as (select sample_id, target, section_no, title, string_agg('['||(rank-1)||'] '||content, chr(10) order by rank) body from i group by 1,2,3,4)
select sample_id, target, string_agg(title||':'||chr(10)||body, chr(10)||chr(10) order by section_no, title) as context, count(*)::bigint as n_sections from s group by 1,2""")
def _(t):
    i = _near(t).select("sample_id", F.when(F.col("speaker") == "user", 1).otherwise(2).alias("section_no"), F.concat("speaker", F.lit(" memories")).alias("title"),
                        F.when(F.col("rank") == 3, "system").otherwise("user").alias("target"), "rank", F.col("turn_id").alias("content"))
    return fu.prompt_sections(i)


@plan("fus_page_replace", f"""with {b.QUESTIONS} select q.sample_id, t.pos as page, (t.pos between q.pos and q.pos+1) as in_full, case when t.pos between q.pos and q.pos+1 then t.text else {_GIST} end as line from questions q join turns t using (conversation_id)""")
def _(t):
    store = b.turns(t).select("conversation_id", F.col("pos").alias("page"), cp.gist("text").alias("gist"), F.col("text").alias("content"))
    sel = b.questions(t).select("sample_id", "conversation_id", F.explode(F.array("pos", F.col("pos") + 1)).alias("page"))
    return fu.page_prompt(store, sel)
