"""Queries for the retrieval lanes."""
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lanes as ln
from ..operators.scale import top_k
from ..session import cut_lineage
from . import bindings as b, sqlkit as k
from .registry import plan


# -- SQL generators --------------------------------------------------------

def scored_bm25(name, queries, docs, profile="lexical", k1=1.2, bb=0.75, floor="1.0"):
    """CTEs `<name>_r`: (sample_id, raw_id, score) of matched records; docs need conversation_id, doc_id, raw_id, text."""
    return f"""{name}_d as (select conversation_id, doc_id, raw_id, {k.toks('text', profile)} t from {docs}),
 {name}_dl as (select conversation_id, doc_id, raw_id, t, len(t) dl from {name}_d),
 {name}_s as (select conversation_id, count(*) n, avg(dl) a from {name}_dl group by 1),
 {name}_p as (select conversation_id, doc_id, raw_id, dl, term, count(*) tf from (select conversation_id, doc_id, raw_id, dl, unnest(t) term from {name}_dl) group by all),
 {name}_f as (select conversation_id, term, count(*) df from {name}_p group by 1,2),
 {name}_q as (select sample_id, conversation_id, term, count(*) qtf from (select sample_id, conversation_id, unnest({k.toks('query_text', profile)}) term from {queries}) group by all),
 {name}_m as (select sample_id, raw_id, doc_id, sum(qtf*ln(1+(n-df+0.5)/(df+0.5))*tf*({k1}+1)/(tf+{k1}*(1-{bb}+{bb}*dl/greatest({floor},a)))) s
   from {name}_q q join {name}_p p using (conversation_id, term) join {name}_f f using (conversation_id, term) join {name}_s s using (conversation_id) group by 1,2,3),
 {name}_r as (select sample_id, raw_id, round(max(s),6) score from {name}_m group by 1,2)"""


def filled(name, queries, docs, scores, order="raw_id", depth=128):
    """CTE `<name>`: ranked 128 with zero fill over all records of the scope."""
    return f"""{name}_z as (select q.sample_id, d.raw_id, d.ord, coalesce(r.score,0.0) score from {queries} q join (select conversation_id, raw_id, min({order}) ord from {docs} group by 1,2) d using (conversation_id)
   left join {scores} r on r.sample_id=q.sample_id and r.raw_id=d.raw_id),
 {name} as (select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, ord, raw_id)::bigint rank from {name}_z) where rank<={depth})"""


RAWDOC = "rawdoc as (select raw_id as doc_id, raw_id, conversation_id, text, pos as ord, * exclude (raw_id, conversation_id, text) from turns)"
FACTDOC = "factdoc as (select assertion_id as doc_id, raw_id, conversation_id, retrieval_text as text, ord from facts)"
PROPDOC = "propdoc as (select proposition_id as doc_id, raw_id, conversation_id, retrieval_text as text, 0 as ord from props)"
Q = "questions"


def raws(t):
    return b.turns(t).withColumn("ord", F.col("pos"))


def fact_docs(t):
    return b.facts(t).select("conversation_id", "raw_id", F.col("assertion_id").alias("doc_id"), F.col("retrieval_text").alias("text"), "ord")


def prop_docs(t):
    return b.propositions(t).select("conversation_id", "raw_id", F.col("proposition_id").alias("doc_id"), F.col("retrieval_text").alias("text"))


def _rank(sql_name):
    return f"select sample_id, raw_id, rank, score from {sql_name}"


def _out(df):
    return df.select("sample_id", "raw_id", "rank", "score")


# -- flagship --------------------------------------------------------------

@plan("flow_bm25_recall", f"""with {b.BENCH_QUESTIONS}, dd as (select raw_id as doc_id, * from docs),
 {scored_bm25('m', 'bq', 'dd')}, {filled('l', 'bq', 'dd', 'm_r', depth=10)},
 g as (select sample_id, count(*) n from bgold group by 1)
select g.sample_id, g.n::bigint as n_gold, count(l.raw_id)::bigint as n_found, round(count(l.raw_id)/g.n,6) as recall, min(l.rank) as first_rank
from g left join bgold b on b.sample_id=g.sample_id left join l on l.sample_id=b.sample_id and l.raw_id=b.raw_id group by g.sample_id, g.n""")
def _(t):
    """BM25 top 10 over all documents for each benchmark passage, with recall of the documents holding the passage."""
    from ..operators.matching import contains_pairs
    q, d = b.bench_questions(t), b.docs(t)
    top = ln.bm25(q, d, "raw", 10)
    sq = lambda c: F.array_join(tx.find_all(c, r"\S+"), " ")
    flat = cut_lineage(d.select("conversation_id", "raw_id", sq(F.col("text")).alias("ht")))   # read several times by the match
    pairs = contains_pairs(q.select("conversation_id", "sample_id", sq(F.col("passage")).alias("nt")), flat, ["conversation_id"], "sample_id", "raw_id")
    exact = pairs.join(q.select("sample_id", "passage"), "sample_id").join(d.select("raw_id", "text"), "raw_id").where(F.contains("text", F.col("passage")))
    gold = exact.select("sample_id", "raw_id")
    hit = gold.join(top.select("sample_id", "raw_id", "rank"), ["sample_id", "raw_id"], "left")
    return hit.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("rank").alias("n_found"),
                                        F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("recall"), F.min("rank").alias("first_rank"))


@plan("idx_df_stats", f"""with d as (select lang as conversation_id, doc_id, {k.toks('text')} t from documents),
 f as (select conversation_id, term, count(*) df from (select conversation_id, doc_id, unnest(list_distinct(t)) term from d) group by 1,2),
 s as (select conversation_id, count(*) n, avg(len(t)) a from d group by 1)
select conversation_id, term, df::bigint as df, n::bigint as n_docs, round(a,6) as avg_len from f join s using (conversation_id)""")
def _(t):
    d = t.documents.select(F.col("lang").alias("conversation_id"), F.col("doc_id").cast("string").alias("raw_id"), "text")
    df, scope = ln.term_stats(d)
    return df.join(scope, "conversation_id").select("conversation_id", "term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@plan("ln_bm25", f"""with {b.BENCH_QUESTIONS}, dd as (select raw_id as doc_id, * from docs), {scored_bm25('m', 'bq', 'dd')}, {filled('l', 'bq', 'dd', 'm_r')} {_rank('l')}""")
def _(t):
    return _out(ln.bm25(b.bench_questions(t), b.docs(t)))


@plan("ln_bm25_probe", f"""with {b.BENCH_QUESTIONS}, dd as (select raw_id as doc_id, * from docs), {scored_bm25('m', 'bq', 'dd', 'space', 1.5, 0.75, '0.000001')},
 {filled('l', 'bq', 'dd', 'm_r')} {_rank('l')}""")
def _(t):
    return _out(ln.bm25(b.bench_questions(t), b.docs(t), k1=1.5, profile="space", floor=1e-6))


_LEX = f"""with {b.QUESTIONS}, {b.FACTS}, {b.PROPS}, {RAWDOC}, {FACTDOC}, {PROPDOC}, {scored_bm25('mr', Q, 'rawdoc')}, {filled('lr', Q, 'rawdoc', 'mr_r')},
 {scored_bm25('ma', Q, 'factdoc')}, {filled('la', Q, 'factdoc', 'ma_r', 'raw_id')}, {scored_bm25('mp', Q, 'propdoc')}, {filled('lp', Q, 'propdoc', 'mp_r', 'raw_id')},
 lpx as (select * from lp union all select * from lr where sample_id not in (select sample_id from lp))"""
_LEX = _LEX.replace(filled('lr', Q, 'rawdoc', 'mr_r'), filled('lr', Q, 'rawdoc', 'mr_r', 'raw_id'))


@plan("ln_lexical_raw", f"{_LEX} {_rank('lr')}")
def _(t):
    return _out(ln.bm25(b.questions(t), raws(t), "raw"))


@plan("ln_lexical_assertion", f"{_LEX} {_rank('la')}")
def _(t):
    return _out(ln.bm25(b.questions(t), fact_docs(t), "assertion"))


@plan("ln_lexical_proposition", f"{_LEX} {_rank('lpx')}")
def _(t):
    return _out(ln.lexical_lanes(b.questions(t), raws(t), fact_docs(t), prop_docs(t)).where("lane = 'proposition'"))


def entity_postings(t):
    f = b.facts(t)
    e = F.array(F.col("relation"), F.col("value"))
    return f.select("conversation_id", "raw_id", F.explode(e).alias("entity")).where("entity <> ''").distinct()


_POST = """postings as (select distinct conversation_id, raw_id, entity from (select conversation_id, raw_id, relation as entity from facts union all select conversation_id, raw_id, value from facts) where entity<>'')"""
_ENT = f"""asked as (select sample_id, conversation_id, target, count(*) times from (select sample_id, conversation_id, unnest(targets) target from questions) group by all),
 escore as (select a.sample_id, p.raw_id, sum(times*case when target=entity then 3 else 1 end)::double score, count(distinct entity) n_names
  from asked a join postings p on a.conversation_id=p.conversation_id and (contains(entity,target) or contains(target,entity)) group by 1,2)"""


@plan("jn_entity_contains", f"with {b.QUESTIONS}, {b.FACTS}, {_POST}, {_ENT} select sample_id, raw_id, score, n_names::bigint as n_names from escore")
def _(t):
    return ln.entity_scores(b.questions(t), entity_postings(t))


def tail_sql(name, head, tail, order="score desc, raw_id"):
    return f"""{name}_u as (select sample_id, raw_id, 0 p, row_number() over (partition by sample_id order by {order}) o, score from {head}
  union all select t.sample_id, t.raw_id, 1, t.rank, 0.0 from {tail} t anti join {head} h on h.sample_id=t.sample_id and h.raw_id=t.raw_id),
 {name} as (select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by p, o)::bigint rank from {name}_u) where rank<=128)"""


@plan("ln_entity", f"{_LEX}, {_POST}, {_ENT}, {tail_sql('le', 'escore', 'la')} {_rank('le')}")
def _(t):
    q = b.questions(t)
    return _out(ln.entity_lane(q, entity_postings(t), ln.bm25(q, fact_docs(t), "assertion")))


_ADJ = "adj as (select distinct a, b from (select source_raw_id a, target_raw_id b from edges union all select target_raw_id, source_raw_id from edges))"
_GRAPH = f"""comb as (select sample_id, raw_id, max(score) score from (select * from mr_r union all select * from ma_r union all select * from mp_r) group by 1,2),
 allraw as (select q.sample_id, t.raw_id, coalesce(c.score,0.0) score from questions q join turns t using (conversation_id) left join comb c on c.sample_id=q.sample_id and c.raw_id=t.raw_id),
 seed as (select * from (select *, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from allraw) where rank<=128),
 hop as (select sample_id, raw_id, round(sum(s),9) score from (select sample_id, raw_id, 1/(20+rank) s from seed where rank<=96
   union all select s.sample_id, a.b, 0.72/(20+rank) from seed s join adj a on a.a=s.raw_id where rank<=96) group by 1,2),
 ghead as (select h.sample_id, h.raw_id, h.score, coalesce(c.score,0.0) base from hop h left join comb c on c.sample_id=h.sample_id and c.raw_id=h.raw_id)"""


def _combined(t):
    q = b.questions(t)
    comb = ln.combined_scores(ln.bm25_scores(q, raws(t)), ln.bm25_scores(q, fact_docs(t)), ln.bm25_scores(q, prop_docs(t)))
    comb = cut_lineage(comb)
    return q, comb, ln.filled(comb, q, raws(t), "seed")


@plan("ln_graph", f"{_LEX}, {b.EDGES}, {_ADJ}, {_GRAPH}, {tail_sql('lg', 'ghead', 'seed', 'score desc, base desc, raw_id')} {_rank('lg')}")
def _(t):
    q, comb, seed = _combined(t)
    return _out(ln.graph_lane(comb, seed, ln.adjacency(b.edges(t))))


# -- vectors ---------------------------------------------------------------

_COS = "list_cosine_similarity(q.v, d.v)"


@plan("ln_dense_raw", f"""with {b.VECTORS}, s as (select q.sample_id, d.doc_id as raw_id, round({_COS},6) score from qvec q join vec d using (conversation_id))
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from s) where rank<=128""")
def _(t):
    return _out(ln.dense_lane(b.query_vectors(t), b.vectors(t).withColumn("raw_id", F.col("doc_id")), "raw_question"))


_DMAX = f"""with {b.VECTORS}, s as (select q.sample_id, d.raw_id, round(max({_COS}),6) score from qvec q join vec d using (conversation_id) group by 1,2)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from s) where rank<=128"""


@plan("ln_dense_max", _DMAX)
def _(t):
    return _out(ln.dense_lane(b.query_vectors(t), b.vectors(t), "assertion_question"))


_BLEND = "list_transform(list_zip(v, list_reverse(v)), lambda x: x[1]*{a}+x[2]*{c})"
_VIEWS = [("plain", 1.0, 0.0), ("speaker", 0.9, 0.1), ("temporal", 0.6, 0.4)]
_QVIEWS = [("question", 1.0, 0.0), ("structured", 0.7, 0.3)]


def _view(vec, a, c):
    """A second view of a vector: mixed with its own reverse."""
    return F.zip_with(vec, F.reverse(vec), lambda x, y: x * a + y * c)


@plan("ln_clause", f"with {b.VECTORS}, dv as (" + " union all ".join(f"select '{n}' dname, raw_id, conversation_id, {_BLEND.format(a=a, c=c)} v from vec" for n, a, c in _VIEWS)
      + "), qv as (" + " union all ".join(f"select '{n}' qname, sample_id, conversation_id, {_BLEND.format(a=a, c=c)} v from qvec" for n, a, c in _QVIEWS)
      + f"""), s as (select 'clause_'||dname||'_'||qname lane, q.sample_id, d.raw_id, round(max({_COS}),6) score from qv q join dv d using (conversation_id) group by 1,2,3)
select * from (select lane, sample_id, raw_id, score, row_number() over (partition by lane, sample_id order by score desc, raw_id)::bigint rank from s) where rank<=128""")
def _(t):
    # A view of the records is indexed and read once for all views of the questions, which are questions of their own in it.
    own = F.concat(F.col("_q"), F.lit("/"), F.col("sample_id"))
    views = F.explode(F.array(*[F.struct(F.lit(n).alias("_q"), _view("vec", a, c).alias("vec")) for n, a, c in _QVIEWS])).alias("x")
    q = b.query_vectors(t).select("sample_id", "conversation_id", views).select("sample_id", "conversation_id", "x.*").withColumn("sample_id", own).drop("_q")
    lanes = [ln.dense_lane(q, b.vectors(t).withColumn("vec", _view("vec", a, c)), f"clause_{n}_") for n, a, c in _VIEWS]
    out = lanes[0].unionByName(lanes[1]).unionByName(lanes[2])
    named = out.withColumn("lane", F.concat("lane", F.expr("substring(sample_id, 1, instr(sample_id, '/') - 1)"))).withColumn("sample_id", F.expr("substring(sample_id, instr(sample_id, '/') + 1)"))
    return named.select("lane", "sample_id", "raw_id", "rank", "score")


@plan("ln_maxsim", """with tok as (select 'r'||(vec_id//3) as raw_id, (label%3)::varchar as conversation_id, list_transform(embedding, lambda x: x::double) v, vec_id from embeddings),
 qt as (select 'q'||(vec_id//7) as sample_id, '0' as c0, conversation_id, v, vec_id from tok where vec_id%7<3),
 best as (select q.sample_id, q.conversation_id, d.raw_id, q.vec_id, max(list_inner_product(q.v,d.v)) m from qt q join tok d using (conversation_id) group by all),
 s as (select sample_id||'-'||conversation_id as sample_id, raw_id, round(avg(m),6) score from best group by 1,2)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from s) where rank<=128""")
def _(t):
    e = t.embeddings.select("vec_id", F.concat(F.lit("r"), F.floor(F.col("vec_id") / 3)).alias("raw_id"), (F.col("label") % 3).cast("string").alias("conversation_id"),
                            F.col("embedding").cast("array<double>").alias("vec"))
    q = e.where("vec_id % 7 < 3").select(F.concat(F.lit("q"), F.floor(F.col("vec_id") / 7), F.lit("-"), "conversation_id").alias("sample_id"), "conversation_id", "vec")
    return _out(ln.maxsim_lane(q, e, "question"))


@plan("ln_sparse_dot", """with dt as (select doc_id::varchar raw_id, lang conversation_id, term, round(ln(1+count(*)),6) weight from (select doc_id, lang, unnest(regexp_extract_all(lower(text),'[a-z0-9'']+')) term from documents) group by all),
 d as (select * from (select *, row_number() over (partition by raw_id order by weight desc, term) rn from dt) where rn<=128),
 qt as (select 'b'||item_id||'-'||lang sample_id, lang conversation_id, term, round(ln(1+count(*)),6) weight from (select item_id, lang, unnest(regexp_extract_all(lower(text),'[a-z0-9'']+')) term from benchmark, (select distinct lang from documents)) group by all),
 q as (select * from (select *, row_number() over (partition by sample_id order by weight desc, term) rn from qt) where rn<=64),
 m as (select sample_id, raw_id, round(sum(q.weight*d.weight),6) score from q join d using (conversation_id, term) group by 1,2),
 z as (select x.sample_id, y.raw_id, coalesce(score,0.0) score from (select distinct sample_id, conversation_id from qt) x join (select distinct raw_id, conversation_id from dt) y using (conversation_id) left join m on m.sample_id=x.sample_id and m.raw_id=y.raw_id)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from z) where rank<=128""")
def _(t):
    w = F.round(F.log(1 + F.count(F.lit(1))), 6).alias("weight")
    d = t.documents.select(F.col("doc_id").cast("string").alias("raw_id"), F.col("lang").alias("conversation_id"), F.explode(tx.tokens("text", "plain")).alias("term"))
    scopes = F.explode(F.array(*map(F.lit, ["en", "fr", "de", "es"]))).alias("conversation_id")
    q = t.benchmark.select("item_id", "text", scopes).select(F.concat(F.lit("b"), "item_id", F.lit("-"), "conversation_id").alias("sample_id"), "conversation_id", F.explode(tx.tokens("text", "plain")).alias("term"))
    return _out(ln.sparse_lane(q.groupBy("sample_id", "conversation_id", "term").agg(w), d.groupBy("raw_id", "conversation_id", "term").agg(w)))


def overlap_sql(name, queries, docs, profile):
    return f"""{name}_q as (select distinct sample_id, conversation_id, term from (select sample_id, conversation_id, unnest({k.toks('query_text', profile)}) term from {queries})),
 {name}_p as (select distinct conversation_id, raw_id, term from (select conversation_id, raw_id, unnest({k.toks('text', profile)}) term from {docs})),
 {name}_r as (select sample_id, raw_id, count(*)::double score from {name}_q join {name}_p using (conversation_id, term) group by 1,2)"""


@plan("ln_set_overlap", f"with {b.BENCH_QUESTIONS}, {overlap_sql('o', 'bq', 'docs', 'word')}, {filled('l', 'bq', 'docs', 'o_r', 'raw_id')} {_rank('l')}")
def _(t):
    return _out(ln.set_overlap(b.bench_questions(t), b.docs(t)))


@plan("ln_typed_lanes", f"""with {b.VECTORS}, d as (select *, {_BLEND.format(a=0.5, c=0.5)} vv, vec_id%4 as owner from vec), q as (select 'q'||vec_id sample_id, conversation_id, v, {_BLEND.format(a=0.2, c=0.8)} vv, vec_id%5 as want from vec where vec_id%7=0),
 p as (select q.sample_id, d.raw_id, d.vec_id, round(list_cosine_similarity(q.v,d.v),6) sem, round(list_cosine_similarity(q.vv,d.vv),6) val, (want=4 or want=owner) own from q join d using (conversation_id)),
 one as (select * from (select *, row_number() over (partition by sample_id, raw_id order by greatest(sem,val) desc, vec_id) rn from p) where rn=1),
 r as (select 'typed_semantic' lane, sample_id, raw_id, sem score, row_number() over (partition by sample_id order by sem desc, raw_id)::bigint rank from one
  union all select 'typed_value', sample_id, raw_id, val, row_number() over (partition by sample_id order by val desc, raw_id)::bigint from one
  union all select 'typed_owner', sample_id, raw_id, sem, row_number() over (partition by sample_id order by own desc, sem desc, raw_id)::bigint from one)
select * from r where rank<=128""")
def _(t):
    v = b.vectors(t)
    want = F.col("vec_id") % 5
    none = F.array().cast("array<string>")
    q = v.where("vec_id % 7 = 0").select(F.concat(F.lit("q"), F.col("vec_id")).alias("sample_id"), "conversation_id", "vec", _view("vec", 0.2, 0.8).alias("value_vec"),
                                         F.when(want == 4, none).otherwise(F.array(want.cast("string"))).alias("owner_terms"))
    d = v.select("raw_id", "conversation_id", F.col("vec_id").alias("ord"), "vec", _view("vec", 0.5, 0.5).alias("value_vec"), F.array((F.col("vec_id") % 4).cast("string")).alias("subject_terms"))
    return ln.typed_lanes(q, d).select("lane", "sample_id", "raw_id", "rank", "score")


# -- structural ------------------------------------------------------------

_SESS = """sessdoc as (select session_no::varchar doc_id, session_no::varchar raw_id, conversation_id, string_agg(text,' ' order by pos) text, session_no ord from turns group by conversation_id, session_no)"""
_EPI = f"""{scored_bm25('ms', Q, 'sessdoc', 'structural')}, {scored_bm25('mo', Q, 'rawdoc', 'structural')},
 epi as (select q.sample_id, t.raw_id, coalesce(s.score,0.0) score, t.session_no, coalesce(o.score,0.0) own from questions q join turns t using (conversation_id)
  left join ms_r s on s.sample_id=q.sample_id and s.raw_id=t.session_no::varchar left join mo_r o on o.sample_id=q.sample_id and o.raw_id=t.raw_id)"""


@plan("ln_episode", f"""with {b.QUESTIONS}, {RAWDOC}, {_SESS}, {_EPI}
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, session_no, own desc, raw_id)::bigint rank from epi) where rank<=128""")
def _(t):
    return _out(ln.episode_lane(b.questions(t), raws(t)))


_ROLE = f"""roledoc as (select assertion_id doc_id, raw_id, conversation_id, pos*1000+ord as ord, concat_ws(' | ', subject, relation, value, event, tm, polarity, modality, speech_act, retrieval_text) text from facts),
 {scored_bm25('mf', Q, 'roledoc', 'structural')}, mfd as (select sample_id, raw_id, doc_id, round(s,6) score from mf_m),
 rstage as (select q.sample_id, d.raw_id, coalesce(m.score,0.0) score, d.ord from questions q join roledoc d using (conversation_id) left join mfd m on m.sample_id=q.sample_id and m.doc_id=d.doc_id),
 rfirst as (select sample_id, raw_id, score, ord from (select *, row_number() over (partition by sample_id, raw_id order by score desc, ord) rn from rstage) where rn=1),
 lrole as (select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, ord)::bigint rank from rfirst) where rank<=128)"""


def _role_facts(t):
    return b.facts(t).withColumn("ord", F.col("pos") * 1000 + F.col("ord"))


@plan("ln_role_fact", f"with {b.QUESTIONS}, {b.FACTS}, {_ROLE} {_rank('lrole')}")
def _(t):
    return _out(ln.role_fact_lane(b.questions(t), _role_facts(t), raws(t)))


@plan("ln_structural_onehop", f"""with {b.QUESTIONS}, {b.FACTS}, {b.EDGES}, {_ADJ}, {_POST}, {_ENT}, {_ROLE},
 oh as (select sample_id, raw_id, 1/(20+rank) s from lrole where rank<=80 union all select l.sample_id, a.b, 0.8/(20+rank) from lrole l join adj a on a.a=l.raw_id where rank<=80
   union all select sample_id, raw_id, 0.025*n_names from escore),
 ohead as (select h.sample_id, h.raw_id, h.score, coalesce(l.rank, 999999) rr from (select sample_id, raw_id, round(sum(s),9) score from oh group by 1,2) h left join lrole l on l.sample_id=h.sample_id and l.raw_id=h.raw_id),
 {tail_sql('lo', 'ohead', 'lrole', 'score desc, rr, raw_id')} {_rank('lo')}""")
def _(t):
    q = b.questions(t)
    role = ln.role_fact_lane(q, _role_facts(t), raws(t))
    return _out(ln.onehop_lane(q, role, ln.adjacency(b.edges(t)), entity_postings(t)))


# -- occurrence ------------------------------------------------------------

def _named_lanes(t):
    """Lanes under the names the occurrence arms read, from overlap, BM25 and positional rankings of the turns."""
    q = b.questions(t)
    bm = ln.bm25(q, raws(t), "raw").select("sample_id", F.lit("lexical").alias("family"), "lane", "raw_id", "rank")
    fa = ln.bm25(q, fact_docs(t), "assertion").select("sample_id", F.lit("lexical").alias("family"), "lane", "raw_id", "rank")
    ov = ln.set_overlap(q, raws(t)).select("sample_id", F.lit("dense").alias("family"), F.explode(F.array(*map(F.lit, ["raw_question", "assertion_structured"]))).alias("lane"), "raw_id", "rank")
    return cut_lineage(bm.unionByName(fa).unionByName(ov))


_SEEDSQL = "spec(arm, family, lane, w) as (values " + ",".join(f"('{a}','{f}','{l}',{w})" for a, ss in ln.OCCURRENCE_SEEDS.items() for f, l, w in ss) + ")"
_W = "case ty " + " ".join(f"when '{a}' then {w}" for a, w in ln.EDGE_WEIGHTS.items()) + " else 0.75 end"
_OCC = f"""{overlap_sql('ov', Q, 'rawdoc', 'word')}, {filled('lov', Q, 'rawdoc', 'ov_r', 'raw_id')},
 nl as (select sample_id, 'lexical' family, 'raw' lane, raw_id, rank from lr union all select sample_id, 'lexical', 'assertion', raw_id, rank from la
  union all select sample_id, 'dense', 'raw_question', raw_id, rank from lov union all select sample_id, 'dense', 'assertion_structured', raw_id, rank from lov),
 {_SEEDSQL}, base as (select sample_id, arm, raw_id, sum(w/(20+rank)) score from nl join spec using (family, lane) group by 1,2,3),
 tadj as (select distinct a, b, ty from (select source_raw_id a, target_raw_id b, edge_type ty from edges union all select target_raw_id, source_raw_id, edge_type from edges
   union all select raw_id, source_raw_id, 'PROPOSITION_SOURCE' from props union all select source_raw_id, raw_id, 'PROPOSITION_SOURCE' from props)),
 s48 as (select * from (select *, row_number() over (partition by sample_id, arm order by round(score,9) desc, raw_id) rn from base) where rn<=48),
 adds as (select s.sample_id, s.arm, e.b raw_id, s.score*{_W} x from s48 s join tadj e on e.a=s.raw_id
  union all select s.sample_id, s.arm, s.raw_id, s.score*0.08 from s48 s join tadj e on e.a=s.raw_id where arm='occ_consensus'
  union all select s.sample_id, s.arm, e2.b, s.score*({_W.replace('case ty', 'case e.ty')})*0.30 from s48 s join tadj e on e.a=s.raw_id join tadj e2 on e2.a=e.b and e2.ty in ('ANTECEDENT','OCCURRENCE','PROPOSITION_SOURCE') and e2.b<>s.raw_id where arm='occ_consensus'),
 tot as (select sample_id, arm, raw_id, round(sum(x),9) score from (select sample_id, arm, raw_id, score x from base union all select * from adds) group by 1,2,3),
 padded as (select sample_id, arm, raw_id, score, 0 p, 0 o from tot union all select q.sample_id, a.arm, t.raw_id, 0.0, 1, t.pos from questions q join turns t using (conversation_id), (select distinct arm from spec) a
   where not exists (select 1 from tot x where x.sample_id=q.sample_id and x.arm=a.arm and x.raw_id=t.raw_id))"""


@plan("ln_occurrence", f"""{_LEX}, {b.EDGES}, {_OCC}
select * from (select sample_id, arm as lane, raw_id, score, row_number() over (partition by sample_id, arm order by p, score desc, o, raw_id)::bigint rank from padded) where rank<=128""")
def _(t):
    p = b.propositions(t).select("raw_id", "source_raw_id")
    return ln.occurrence_lanes(_named_lanes(t), ln.typed_adjacency(b.edges(t), p), raws(t), b.questions(t)).select("sample_id", "lane", "raw_id", "rank", "score")


@plan("jn_adjacency", """with e as (select 'o'||l_orderkey a, 'p'||l_partkey b from lineitem union all select 'p'||l_partkey, 's'||l_suppkey from lineitem)
select a, b from e union select b, a from e""")
def _(t):
    return ln.adjacency(_incidence(t))


def _incidence(t):
    pair = F.array(F.struct(F.concat(F.lit("o"), "l_orderkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("d")),
                   F.struct(F.concat(F.lit("p"), "l_partkey").alias("s"), F.concat(F.lit("s"), "l_suppkey").alias("d")))
    return t.lineitem.select(F.explode(pair).alias("x")).select(F.col("x.s").alias("source_raw_id"), F.col("x.d").alias("target_raw_id"), F.lit("INCIDENCE").alias("edge_type"))


_INC = """inc as (select 'o'||l_orderkey a, 'p'||l_partkey b from lineitem union all select 'p'||l_partkey, 's'||l_suppkey from lineitem), adj as (select a, b from inc union select b, a from inc),
 seeds as (select 'c'||o_custkey sample_id, 'o'||o_orderkey raw_id, 1/(20+row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)) score from orders)"""


def _order_seeds(t):
    r = top_k(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], None)
    return r.select(F.concat(F.lit("c"), "o_custkey").alias("sample_id"), F.concat(F.lit("o"), "o_orderkey").alias("raw_id"), (1 / (20 + F.col("rank"))).alias("score"))


@plan("jn_one_hop", f"""with {_INC} select sample_id, raw_id, round(sum(score),6) as score from (select * from seeds union all select s.sample_id, a.b, s.score*0.72 from seeds s join adj a on a.a=s.raw_id) group by 1,2""")
def _(t):
    return ln.one_hop(_order_seeds(t), ln.undirected(_incidence(t)), 0.72).withColumn("score", F.round("score", 6))


def _typed(t):
    """Orders meet their parts by two edge types, parts meet suppliers by an antecedent edge."""
    kind = F.when(F.col("l_linenumber") % 2 == 1, "OCCURRENCE").otherwise("CONFIRMATION")
    pair = F.array(F.struct(F.concat(F.lit("o"), "l_orderkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("d"), kind.alias("k")),
                   F.struct(F.concat(F.lit("p"), "l_partkey").alias("s"), F.concat(F.lit("s"), "l_suppkey").alias("d"), F.lit("ANTECEDENT").alias("k")))
    return t.lineitem.select(F.explode(pair).alias("x")).select(F.col("x.s").alias("source_raw_id"), F.col("x.d").alias("target_raw_id"), F.col("x.k").alias("edge_type"))


@plan("jn_two_hop", f"""with {_INC}, te as (select 'o'||l_orderkey a, 'p'||l_partkey b, case when l_linenumber%2=1 then 'OCCURRENCE' else 'CONFIRMATION' end ty from lineitem union select 'p'||l_partkey, 's'||l_suppkey, 'ANTECEDENT' from lineitem),
 ta as (select a, b, ty, case ty when 'OCCURRENCE' then 0.90 when 'CONFIRMATION' then 0.92 else 0.95 end::double w from (select a, b, ty from te union select b, a, ty from te)),
 hop as (select s.sample_id, s.raw_id, s.score, e.b, e.w from seeds s join ta e on e.a=s.raw_id),
 adds as (select sample_id, b raw_id, score*w x from hop union all select sample_id, raw_id, score*0.08 from hop
  union all select h.sample_id, e.b, h.score*h.w*0.30 from hop h join ta e on e.a=h.b where e.ty in ('ANTECEDENT','OCCURRENCE','PROPOSITION_SOURCE') and e.b<>h.raw_id)
select sample_id, raw_id, round(sum(x),9) as score from adds group by 1,2 having round(sum(x),9)<>0""")
def _(t):
    seeds = _order_seeds(t).withColumn("arm", F.lit("occ_consensus"))
    h = ln.two_hop(seeds, ln.undirected(_typed(t)))
    return h.select("sample_id", "raw_id", (F.round("score", 9) + 0.0).alias("score")).where("score <> 0")


def word_share_sql(depth):
    """Best records of each question's conversation by the share of its words that they hold."""
    tq, tt = k.tokset("q.query_text", "plain"), k.tokset("t.text", "plain")
    return f"""with {b.QUESTIONS}, s as (select q.sample_id, t.raw_id, round(len(list_intersect({tq}, {tt}))/greatest(len({tq}),1),6) score, count(*) over (partition by q.sample_id) n from questions q join turns t using (conversation_id))
select sample_id, raw_id, rank, score, n::bigint as n_candidates from (select *, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from s) where rank<={depth}"""


def word_share(t, depth):
    from ..operators.joins import scoped_cross, word_share as share
    q = b.questions(t).select("sample_id", "conversation_id", tx.token_set("query_text", "plain").alias("asked"))
    return scoped_cross(q, b.turns(t).select("conversation_id", "raw_id", tx.token_set("text", "plain").alias("words")), share("words", "asked"), depth)


@plan("jn_scoped_cross", word_share_sql(3))
def _(t):
    return word_share(t, 3)


# -- system lanes ----------------------------------------------------------

_TFIDF = f"""tf as (select conversation_id, raw_id, term, count(*) tf from (select conversation_id, raw_id, unnest({k.toks('text', 'pairs')}) term from {{docs}}) group by all),
 nn as (select conversation_id, count(*) n from {{docs}} group by 1), idf as (select conversation_id, term, ln((1+n)/(1+count(*)))+1 idf from tf join nn using (conversation_id) group by conversation_id, term, n),
 qt as (select sample_id, conversation_id, term, count(*) qtf from (select sample_id, conversation_id, unnest({k.toks('query_text', 'pairs')}) term from {{queries}}) group by all),
 qi as (select q.*, coalesce(idf,1.0) idf from qt q left join idf using (conversation_id, term)), qn as (select sample_id, sqrt(sum((qtf*idf)**2)) qn from qi group by 1),
 dn as (select raw_id, sqrt(sum((tf*idf)**2)) dn from tf join idf using (conversation_id, term) group by 1),
 dot as (select sample_id, raw_id, sum(tf*qtf*idf**2) dot from qi join tf using (conversation_id, term) group by 1,2),
 tr as (select sample_id, raw_id, round(dot/(qn*dn),6) score from dot join dn using (raw_id) join qn using (sample_id))"""


@plan("ln_tfidf_cosine", f"with {b.BENCH_QUESTIONS}, {_TFIDF.format(docs='docs', queries='bq')}, {filled('l', 'bq', 'docs', 'tr', 'ord')} {_rank('l')}")
def _(t):
    return _out(ln.tfidf_cosine(b.bench_questions(t), b.docs(t)))


_OBS = """obs as (select raw_id||coalesce('#'||ord,'') as raw_id, conversation_id, fact as text, pos*1000+coalesce(ord,0) as ord from (
  select t.raw_id, t.conversation_id, t.pos, c.ord, coalesce(c.clause, t.text) fact from turns t left join (select * from clauses where pos%2=0) c on c.raw_id=t.raw_id))"""


@plan("ln_tfidf_observation", f"with {b.QUESTIONS}, {b.FACTS}, {_OBS}, {_TFIDF.format(docs='obs', queries='questions')}, {filled('l', 'questions', 'obs', 'tr', 'ord')} {_rank('l')}")
def _(t):
    tt = b.turns(t)
    o = b.facts(t).where("pos % 2 = 0").join(tt.select("raw_id", "turn_id"), "raw_id").select("conversation_id", "turn_id", F.col("retrieval_text").alias("fact"), F.col("ord").alias("n"))
    d = ln.observation_docs(tt, o).withColumn("ord", F.col("ord.pos") * 1000 + F.col("ord.col2"))
    return _out(ln.tfidf_cosine(b.questions(t), d))


_TOV = f"""oq as (select sample_id, conversation_id, term, count(*) qtf from (select sample_id, conversation_id, unnest({k.toks('query_text', 'plain')}) term from {{q}}) group by all),
 op as (select conversation_id, raw_id, term, count(*) tf from (select conversation_id, raw_id, unnest({k.toks('text', 'plain')}) term from {{d}}) group by all), on_ as (select sample_id, sum(qtf) n from oq group by 1),
 ot as (select sample_id, raw_id, round(sum(least(tf,qtf))/max(n),6) score from oq join op using (conversation_id, term) join on_ using (sample_id) group by 1,2)"""


@plan("ln_term_overlap", f"with {b.BENCH_QUESTIONS}, {_TOV.format(q='bq', d='docs')}, {filled('l', 'bq', 'docs', 'ot', 'ord')} {_rank('l')}")
def _(t):
    return _out(ln.term_overlap(b.bench_questions(t), b.docs(t)))


@plan("ln_page_lookup", f"""with {b.QUESTIONS}, pg as (select conversation_id, raw_id, text, pos ord from turns), {_TOV.format(q='questions', d='pg')},
 z as (select q.sample_id, p.raw_id, p.ord, coalesce(o.score,0.0) score from questions q join pg p using (conversation_id) left join ot o on o.sample_id=q.sample_id and o.raw_id=p.raw_id),
 m as (select *, max(score) over (partition by sample_id) best from z)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, ord)::bigint rank from m where score>0 or best=0) where rank<=5""")
def _(t):
    return _out(ln.page_lookup(b.questions(t), raws(t)))


@plan("ln_hybrid", f"""with v as (select e.vec_id, label::varchar conversation_id, list_transform(embedding, lambda x: x::double) v, regexp_extract_all(lower(d.text),'[a-z0-9'']+') w from embeddings e join documents d on d.doc_id=e.vec_id),
 tf as (select vec_id, term, count(*) tf from (select vec_id, unnest(w) term from v) group by all),
 q as (select 'q'||vec_id sample_id, conversation_id, v, w from v where vec_id%7=0), qt as (select sample_id, conversation_id, term, count(*) qtf from (select sample_id, conversation_id, unnest(w) term from q) group by all),
 lex as (select sample_id, d.vec_id, sum(least(tf,qtf)) o from qt join v d using (conversation_id) join tf on tf.vec_id=d.vec_id and tf.term=qt.term group by 1,2),
 s as (select q.sample_id, 'd'||d.vec_id raw_id, d.vec_id ord, round(0.85*{_COS}+0.15*coalesce(o,0)/greatest(len(q.w),1),6) score from q join v d using (conversation_id) left join lex l on l.sample_id=q.sample_id and l.vec_id=d.vec_id)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, ord)::bigint rank from s) where rank<=128""")
def _(t):
    e = t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id")).select(
        "vec_id", F.col("label").cast("string").alias("conversation_id"), F.col("embedding").cast("array<double>").alias("vec"), tx.tokens("text", "plain").alias("terms"))
    q = e.where("vec_id % 7 = 0").select(F.concat(F.lit("q"), "vec_id").alias("sample_id"), "conversation_id", "vec", "terms")
    d = e.select(F.concat(F.lit("d"), "vec_id").alias("raw_id"), "conversation_id", F.col("vec_id").alias("ord"), "vec", "terms")
    return _out(ln.hybrid_lane(q, d))


@plan("ln_vector_topk", f"""with {b.VECTORS}, ent as (select conversation_id, 'summary'||conversation_id as raw_id, v from vec where vec_id%11=0 qualify row_number() over (partition by conversation_id order by vec_id)=1
  union all select conversation_id, 'pair'||(vec_id//2), v from vec), s as (select q.sample_id, d.raw_id, round(max({_COS}),6) score from qvec q join ent d using (conversation_id) group by 1,2)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from s) where rank<=10""")
def _(t):
    v = b.vectors(t)
    summary = v.where("vec_id % 11 = 0").groupBy("conversation_id").agg(F.min_by("vec", "vec_id").alias("vec")).withColumn("raw_id", F.concat(F.lit("summary"), "conversation_id"))
    pairs = v.select("conversation_id", "vec", F.concat(F.lit("pair"), F.floor(F.col("vec_id") / 2)).alias("raw_id"))
    return _out(ln.dense_lane(b.query_vectors(t), summary.unionByName(pairs), "buckets", 10))


@plan("ln_phrase_bonus", f"""with {b.QUESTIONS}, {overlap_sql('o', 'questions', 'turns', 'search')}, n as (select sample_id, count(*) n from o_q group by 1),
 long as (select * from o_q where length(term)>4), bon as (select distinct l.sample_id, t.raw_id from long l join turns t on t.conversation_id=l.conversation_id and contains(lower(t.text), l.term)),
 z as (select q.sample_id, t.raw_id, t.pos, round(coalesce(o.score,0)/n + case when b.raw_id is not null then 0.5 else 0 end,6) score from questions q join turns t using (conversation_id) join n using (sample_id)
  left join o_r o on o.sample_id=q.sample_id and o.raw_id=t.raw_id left join bon b on b.sample_id=q.sample_id and b.raw_id=t.raw_id where len({k.toks('t.text', 'search')})>0)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, pos)::bigint rank from z where score>0) where rank<=10""")
def _(t):
    return _out(ln.passage_lane(b.questions(t), raws(t)))


@plan("ln_date_boost", f"""with {b.QUESTIONS}, dq as (select sample_id, conversation_id, query_text||case when pos%4=0 then ' in '||strftime(date '2023-01-01' + (conversation_id::int%300 + pos//4)::int, '%B %Y') when pos%4=2 then ' on '||strftime(date '2023-01-01' + (conversation_id::int%300 + pos//4)::int, '%-d %B, %Y') else '' end as query_text from questions),
 dt as (select raw_id, conversation_id, pos, strftime(date '2023-01-01' + (conversation_id::int%300 + session_no-1)::int, '%-d %B, %Y') ts, text body, lower(speaker||' '||strftime(date '2023-01-01' + (conversation_id::int%300 + session_no-1)::int, '%-d %B, %Y')||' '||text) as text from turns),
 {overlap_sql('o', 'dq', 'dt', 'query')},
 z as (select o.sample_id, o.raw_id, d.pos, o.score + case when contains(lower(q.query_text), lower(d.ts)) then 6 else 0 end
   + 2*len(list_filter({k.slist(tx.MONTH_NAMES)}, lambda m: contains(lower(q.query_text), m) and contains(lower(d.ts), m))) + 2*len(list_filter(regexp_extract_all(q.query_text,'\\b\\d{{4}}\\b'), lambda y: contains(d.ts, y))) as score
   from o_r o join dq q using (sample_id) join dt d using (raw_id))
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, pos)::bigint rank from z) where rank<=8""")
def _(t):
    day = lambda conv, n: F.date_add(F.lit("2023-01-01").cast("date"), (conv.cast("int") % 300 + n).cast("int"))
    q = b.questions(t)
    when = day(F.col("conversation_id"), F.floor(F.col("pos") / 4))
    q = q.withColumn("query_text", F.concat("query_text", F.when(F.col("pos") % 4 == 0, F.concat(F.lit(" in "), F.date_format(when, "MMMM yyyy")))
                                            .when(F.col("pos") % 4 == 2, F.concat(F.lit(" on "), F.date_format(when, "d MMMM, yyyy"))).otherwise("")))
    d = raws(t).withColumn("timestamp", F.date_format(day(F.col("conversation_id"), F.col("session_no") - 1), "d MMMM, yyyy"))
    return _out(ln.date_boost_lane(q, d))


@plan("ln_window_chunks", f"""with {b.QUESTIONS}, tt as (select *, count(*) over (partition by conversation_id, session_no) ns, {k.tokset('text', 'window')} w from turns),
 qw as (select sample_id, conversation_id, {k.tokset('query_text', 'window')} qt from questions),
 hit as (select q.sample_id, q.conversation_id, q.qt, t.session_no, t.idx, t.ns from qw q join tt t using (conversation_id) where len(list_intersect(q.qt,t.w))>0),
 win as (select distinct sample_id, conversation_id, qt, session_no, greatest(idx-2,1) lo, least(idx+2,ns) hi from hit),
 sc as (select w.sample_id, w.session_no, w.lo, w.hi, round(len(list_intersect(w.qt, flatten(list(t.w))))/len(w.qt),6) score from win w join tt t on t.conversation_id=w.conversation_id and t.session_no=w.session_no and t.idx between w.lo and w.hi group by w.sample_id, w.session_no, w.lo, w.hi, w.qt),
 quiet as (select q.sample_id, t.session_no, 1 lo, least(3, t.ns) hi, 0.0 score from questions q join tt t using (conversation_id) where t.idx=1 and not exists (select 1 from hit h where h.sample_id=q.sample_id and h.session_no=t.session_no)),
 u as (select * from sc union all select * from quiet)
select sample_id, session_no::bigint as session_no, lo::bigint as lo, hi::bigint as hi, score, rank from (select *, row_number() over (partition by sample_id order by score desc, session_no, lo, hi)::bigint rank from u) where rank<=5""")
def _(t):
    n = b.turns(t).groupBy("conversation_id", "session_no").agg(F.count(F.lit(1)).alias("n_session"))
    d = b.turns(t).join(n, ["conversation_id", "session_no"])
    return ln.window_chunks(b.questions(t), d).select("sample_id", F.col("session_no").cast("bigint").alias("session_no"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"),
                                                      "score", F.col("rank").cast("bigint").alias("rank"))


@plan("ln_rerank", f"""with {b.LANES}, p as (select sample_id, raw_id, rank as original_rank, round(('0x'||substr(md5(sample_id||raw_id),1,6))::bigint/16777216.0,6) score from lanes where lane='newest' and rank<=20)
select sample_id, raw_id, original_rank::bigint as original_rank, row_number() over (partition by sample_id order by score desc, raw_id)::bigint as new_rank, score from p""")
def _(t):
    pool = b.lanes(t, ["newest"]).where("rank <= 20").select("sample_id", "raw_id", "rank")
    s = pool.select("sample_id", "raw_id", F.round(F.conv(F.substring(F.md5(F.concat("sample_id", "raw_id")), 1, 6), 16, 10).cast("double") / 16777216.0, 6).alias("score"))
    return ln.rerank(pool, s)[0]


@plan("ln_gap_search", f"""with {b.LANES}, gaps as (select distinct sample_id, g from lanes, (values ('g1'),('g2'),('g3')) x(g)),
 cand as (select sample_id, 'g1' g, raw_id from lanes where lane='price_desc' and rank<=64 union select sample_id, 'g2', raw_id from lanes where lane='oldest' and rank<=64
   union select l.sample_id, x.g, l.raw_id from lanes l, (values ('g1'),('g2')) x(g) where lane='newest' and rank<=20),
 sc as (select *, round(('0x'||substr(md5(g||raw_id),1,6))::bigint/16777216.0,6) score from cand),
 best as (select sample_id, raw_id, max(score) score from sc s where score>=0.5 and not exists (select 1 from lanes l where l.lane='newest' and l.rank<=3 and l.sample_id=s.sample_id and l.raw_id=s.raw_id) group by 1,2)
select * from (select sample_id, raw_id, score, row_number() over (partition by sample_id order by score desc, raw_id)::bigint rank from best) where rank<=5""")
def _(t):
    l = b.lanes(t)
    new = l.where("lane = 'newest'")
    gaps = l.select("sample_id").distinct().withColumn("gap_id", F.explode(F.array(*map(F.lit, ["g1", "g2", "g3"]))))
    dense = l.where("lane = 'price_desc'").withColumn("gap_id", F.lit("g1")).unionByName(l.where("lane = 'oldest'").withColumn("gap_id", F.lit("g2"))).select("sample_id", "gap_id", "raw_id", "rank")
    pool = new.where("rank <= 20")
    pairs = dense.select("sample_id", "gap_id", "raw_id").unionByName(pool.select("sample_id", F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("gap_id"), "raw_id")).distinct()
    s = pairs.withColumn("score", F.round(F.conv(F.substring(F.md5(F.concat("gap_id", "raw_id")), 1, 6), 16, 10).cast("double") / 16777216.0, 6))
    return _out(ln.gap_search(gaps, dense, pool, new.where("rank <= 3"), s))


def _route_sql(mode):
    order = "route, rn" if mode == "faithful" else "rn, route"
    return f"""with {b.LANES}, a as (select sample_id, 1 route, row_number() over (partition by sample_id order by rank) rn, raw_id entry_id, raw_id content from lanes where lane='newest' qualify rn<=6),
 b0 as (select sample_id, lane ty, raw_id entry_id, raw_id content, rank*10+case when lane='price_desc' then 0 else 1 end place from lanes where lane in ('price_desc','price_asc')),
 b1 as (select sample_id, entry_id, content, min(place) place from b0 group by sample_id, ty, entry_id, content),
 bb as (select sample_id, 2 route, row_number() over (partition by sample_id order by place) rn, entry_id, content from b1 qualify rn<=8),
 u as (select *, row_number() over (partition by sample_id, content order by {order}) k from (select * from a union all select * from bb))
select '{mode}' as mode, sample_id, route::bigint as route, entry_id, content, row_number() over (partition by sample_id order by {order})::bigint as rank from u where k=1"""


@plan("ln_route_merge", f"select * from ({_route_sql('faithful')}) union all select * from ({_route_sql('interleaved')})")
def _(t):
    l = b.lanes(t)
    first = l.where("lane = 'newest'").select("sample_id", F.col("rank").alias("place"), F.col("raw_id").alias("entry_id"), F.col("raw_id").alias("content"))
    second = l.where("family = 'price'").select("sample_id", (F.col("rank") * 10 + F.when(F.col("lane") == "price_desc", 0).otherwise(1)).alias("place"), F.col("raw_id").alias("entry_id"),
                                                F.col("raw_id").alias("content"), F.col("lane").alias("type"))
    out = [ln.route_merge(first, second, m, 6, 8).withColumn("mode", F.lit(m)) for m in ("faithful", "interleaved")]
    return out[0].unionByName(out[1]).withColumn("route", F.col("route").cast("bigint"))


@plan("ln_type_cap", f"""with s as (select 'c'||o_custkey sample_id, o_orderstatus memory_type, 'o'||o_orderkey raw_id, o_totalprice score from orders)
select sample_id, memory_type, raw_id, rank from (select *, row_number() over (partition by sample_id, memory_type order by score desc, raw_id)::bigint rank from s) where rank<=3""")
def _(t):
    s = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("memory_type"), F.concat(F.lit("o"), "o_orderkey").alias("raw_id"), F.col("o_totalprice").alias("score"))
    return ln.type_cap(s, 3).select("sample_id", "memory_type", "raw_id", F.col("rank").cast("bigint").alias("rank"))
