"""Queries for answer, evidence and report metrics."""
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import contracts as ct, metrics as me
from . import bindings as b, sqlkit as k
from .registry import plan
from .text_plans import dates_sql

# -- labelled documents with evidence: the result rows of the reports -------

# ids of a row's gold evidence, of what was retrieved, and of what was injected
RESULTS = f"""res0 as (select l.doc_id, l.doc_id::varchar as sample_id, d.source as system, d.lang as original_category, 'T1_fact' as task_type, d.lang as question_type, d.text, d.n_chars,
  case l.doc_id%4 when 0 then ['D1:'||(l.doc_id%5),'D2:1'] when 1 then ['see D1:'||(l.doc_id%5)] when 2 then ['s'||(l.doc_id%3)] else [] end gold_ids,
  case l.doc_id%3 when 0 then ['d1:'||(l.doc_id%5),'D9:9'] when 1 then ['D2:1','S'||(l.doc_id%3)] else ['D8:8'] end ret_ids,
  case l.doc_id%5 when 0 then ['D1:'||(l.doc_id%5),'D2:1'] when 1 then ['D2:1','s1','D1:1'] when 2 then ['s2'] else ['D7:7'] end inj_ids,
  l.doc_id%17=0 as failed, l.toxic=1 as toxic, l.quality=1 as grade from labels l join documents d on d.doc_id=l.doc_id)"""


def results(t):
    d = F.col("doc_id")
    s = lambda *xs: F.array(*xs)
    cat = lambda p, m: F.concat(F.lit(p), (d % m))
    none = F.array().cast("array<string>")
    j = t.labels.join(t.documents, "doc_id")
    return j.select(
        "doc_id", d.cast("string").alias("sample_id"), F.col("source").alias("system"), F.col("lang").alias("original_category"), F.lit("T1_fact").alias("task_type"),
        F.col("lang").alias("question_type"), "text", "n_chars",
        F.when(d % 4 == 0, s(cat("D1:", 5), F.lit("D2:1"))).when(d % 4 == 1, s(cat("see D1:", 5))).when(d % 4 == 2, s(cat("s", 3))).otherwise(none).alias("gold_ids"),
        F.when(d % 3 == 0, s(cat("d1:", 5), F.lit("D9:9"))).when(d % 3 == 1, s(F.lit("D2:1"), cat("S", 3))).otherwise(s(F.lit("D8:8"))).alias("retrieved_ids"),
        F.when(d % 5 == 0, s(cat("D1:", 5), F.lit("D2:1"))).when(d % 5 == 1, s(F.lit("D2:1"), F.lit("s1"), F.lit("D1:1"))).when(d % 5 == 2, s(F.lit("s2"))).otherwise(s(F.lit("D7:7"))).alias("injected_ids"),
        (d % 17 == 0).alias("failed"), (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("grade"))


def _idset(c):
    return (f"list_distinct(list_filter(flatten(list_transform({c}, lambda x: case when len(regexp_extract_all(x,'(?i)\\bD\\d+:\\d+\\b'))>0 then "
            f"list_transform(regexp_extract_all(x,'(?i)\\bD\\d+:\\d+\\b'), lambda y: lower(y)) else [lower(x)] end)), lambda x: x<>''))")


_EVID = f"""ev as (select *, {_idset('gold_ids')} g, {_idset('ret_ids')} r, {_idset('inj_ids')} i from res0),
 ev2 as (select *, len(g)>0 as has_gold, case when len(g)>0 then len(list_intersect(g,r))/len(g) end rr, case when len(g)>0 then len(list_intersect(g,i))/len(g) end pc from ev)"""


@plan("agg_recall", f"""with {RESULTS}, {_EVID} select sample_id, system, round(rr,6) as recall, rr>0 as hit, rr=1 as complete, round(pc,6) as prompt_recall from ev2""")
def _(t):
    r = results(t)
    return r.select("sample_id", "system", F.round(me.recall("gold_ids", "retrieved_ids"), 6).alias("recall"), me.hit("gold_ids", "retrieved_ids").alias("hit"),
                    me.complete("gold_ids", "retrieved_ids").alias("complete"), F.round(me.recall("gold_ids", "injected_ids"), 6).alias("prompt_recall"))


# answers: question text against the following turn, with some rewritten, dated, refused or empty
ANSWERS = f"""{b.QUESTIONS}, ans as (select q.sample_id, q.conversation_id, q.pos, q.speaker, case (q.pos+length(q.query_text))%6 when 0 then 'Answer: '||q.query_text when 1 then 'It was on 5 March 2023, the time' when 2 then coalesce(t.text,'none')
   when 3 then 'Not enough information' when 4 then '' else q.query_text||' and more words after that one' end as pred_answer,
  case (q.pos+length(q.query_text))%6 when 1 then 'the 2023-03-05' when 3 then '' when 4 then 'May 8, 2023' else q.query_text end as gold_answer from questions q left join turns t on t.conversation_id=q.conversation_id and t.pos=q.pos+1)"""


def answers(t):
    nxt = b.turns(t).select("conversation_id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("nt"))
    q = b.questions(t).join(nxt, ["conversation_id", "pos"], "left")
    m = (F.col("pos") + F.length("query_text")) % 6
    return q.select("sample_id", "conversation_id", "pos", "speaker",
                    F.when(m == 0, F.concat(F.lit("Answer: "), "query_text")).when(m == 1, "It was on 5 March 2023, the time").when(m == 2, F.coalesce("nt", F.lit("none")))
                    .when(m == 3, "Not enough information").when(m == 4, "").otherwise(F.concat("query_text", F.lit(" and more words after that one"))).alias("pred_answer"),
                    F.when(m == 1, "the 2023-03-05").when(m == 3, "").when(m == 4, "May 8, 2023").otherwise(F.col("query_text")).alias("gold_answer"))


def _overlap_sql(src, key, p, g):
    return f"""pt as (select {key}, w, count(*) n from (select {key}, unnest({p}) w from {src}) group by all), gt as (select {key}, w, count(*) n from (select {key}, unnest({g}) w from {src}) group by all),
 ov as (select a.*, coalesce(len({p}),0) np, coalesce(len({g}),0) ng, coalesce(o,0) o from {src} a left join (select pt.{key}, sum(least(pt.n,gt.n)) o from pt join gt on pt.{key}=gt.{key} and pt.w=gt.w group by 1) x on x.{key}=a.{key})"""


def _atok(c):
    return f"regexp_extract_all({k.norm_match(c)},'[a-z0-9'']+')"


_F1 = "case when np=0 and ng=0 then 1.0 when np=0 or ng=0 or o=0 then 0.0 else 2*o/(np+ng) end"
_B1 = "case when np=0 and ng=0 then 1.0 when np=0 or ng=0 then 0.0 else case when np>ng then 1.0 else pow(2.718281828, 1-ng/np) end * o/np end"


@plan("agg_token_f1", f"with {ANSWERS}, {_overlap_sql('ans', 'sample_id', _atok('pred_answer'), _atok('gold_answer'))} select sample_id, np::bigint as n_pred, ng::bigint as n_gold, o::bigint as overlap, round({_F1},6) as token_f1 from ov")
def _(t):
    return me.token_f1(answers(t), ["sample_id"]).withColumn("token_f1", F.round("token_f1", 6))


@plan("agg_bleu1", f"with {ANSWERS}, {_overlap_sql('ans', 'sample_id', _atok('pred_answer'), _atok('gold_answer'))} select sample_id, round({_B1},6) as bleu_1 from ov")
def _(t):
    return me.bleu1(answers(t), ["sample_id"]).select("sample_id", F.round("bleu_1", 6).alias("bleu_1"))


_MT = "list_distinct(regexp_extract_all(translate(lower({c}),'.,!?','    '),'\\S+'))"


@plan("agg_set_f1", f"""with {ANSWERS}, s as (select sample_id, {_MT.format(c='pred_answer')} p, {_MT.format(c='gold_answer')} g from ans)
select sample_id, round(case when len(p)=0 or len(g)=0 or len(list_intersect(p,g))=0 then 0.0 else 2*len(list_intersect(p,g))/(len(p)+len(g)) end,6) as set_f1 from s""")
def _(t):
    return answers(t).select("sample_id", F.round(me.set_f1(), 6).alias("set_f1"))


_WT = "regexp_extract_all(lower({c}),'[\\p{{L}}\\p{{N}}\\p{{M}}_'']+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]')"


@plan("agg_bleu1_smoothed", f"with {ANSWERS}, {_overlap_sql('ans', 'sample_id', _WT.format(c='pred_answer'), _WT.format(c='gold_answer'))} select sample_id, round(case when np=0 or ng=0 then 0.0 else case when np>ng then 1.0 else exp(1-ng/np) end * (case when o=0 then 0.1 else o end)/np end,6) as bleu_1 from ov")
def _(t):
    return me.bleu1_smoothed(answers(t), ["sample_id"]).select("sample_id", F.round("bleu_1", 6).alias("bleu_1"))


@plan("agg_category_f1")
def _(t):
    return me.category_f1(answers(t).withColumn("category", (F.col("pos") % 3 + 1).cast("string"))).withColumn("category_f1", F.round("category_f1", 6))


@plan("ext_stem")
def _(t):
    from ..functions.python_udfs import stem
    w = t.documents.select(F.explode(tx.tokens("text", "lexical")).alias("word")).distinct()
    return w.select("word", stem("word").alias("stem"))


@plan("agg_lexical_report", f"""with {b.JUDGED} select system, case when grouping(category)=1 then 'overall' else category end as category, count(*)::bigint as n, round(avg(n_chars),6) as n_chars, round(avg(grade::int),6) as grade
 from judged where category<>'5' group by grouping sets ((system),(system,category))""")
def _(t):
    r = b.judged(t).where("category <> '5'").withColumn("grade", F.col("grade").cast("int"))
    return me.lexical_report(r, ["n_chars", "grade"])


# -- the whole metric vector ------------------------------------------------

def _canon(c):
    """Canonical form of texts without tags or fences."""
    return k.norm(f"regexp_replace(trim({k.strip(f'regexp_replace({k.norm(c)},{k.q(chr(40) + chr(63) + chr(105) + chr(41) + chr(94) + chr(40) + chr(97) + chr(110) + chr(115) + chr(119) + chr(101) + chr(114) + chr(41) + chr(58) + chr(92) + chr(115) + chr(42))},{k.q(str())})')}, chr(32)||chr(9)||chr(13)||chr(10)||chr(39)||chr(34)||chr(96)),'^\\s*[-*•]\\s*','')")


_VEC = f"""{ANSWERS}, a1 as (select *, {_canon('pred_answer')} ep, {_canon('gold_answer')} eg from ans), a2 as (select *, {k.norm_match('ep')} np_, {k.norm_match('eg')} ng_ from a1),
 {_overlap_sql('a2', 'sample_id', _atok('ep'), _atok('eg'))},
 pd as (select sample_id sid, list(d) pdl from ({dates_sql('select sample_id, ep from a2', 'sample_id', 'ep')}) group by 1), gd as (select sample_id sid, list(d) gdl from ({dates_sql('select sample_id, eg from a2', 'sample_id', 'eg')}) group by 1),
 a3 as (select ov.*, coalesce(pdl,[]) pdl, coalesce(gdl,[]) gdl, {_F1} f, {_B1} bl, regexp_matches(np_, {k.q('|'.join(['not enough information', 'not enough info', 'insufficient information', 'no answer', 'unknown', 'cannot be determined', 'cannot be answered', 'no information', 'not mentioned', 'not available']))}) or np_='' as refusal
   from ov left join pd on pd.sid=ov.sample_id left join gd on gd.sid=ov.sample_id),
 a4 as (select *, len(gdl)>0 and len(pdl)>0 dated, len(list_intersect(gdl,pdl))=len(gdl) covers, np_=ng_ same, contains(np_,ng_) inside, len(regexp_extract_all(np_,'\\S+'))>5 corr from a3),
 a5 as (select *, case when ng_='' then refusal or corr when len(gdl)>0 then (same or inside or (dated and covers)) and not (dated and not covers) else same or f>=0.5 or inside end ok from a4)"""


def vector_rows(t):
    none = F.array().cast("array<string>")
    g = b.gold(t).select("sample_id", F.col("turn_id").alias("gt"))
    a = answers(t).join(g, "sample_id", "left")
    turn = F.concat(F.lit("D"), F.floor(F.col("pos") / 4) + 1, F.lit(":"), F.col("pos") % 4 + 2)
    return a.select("sample_id", F.lit("mem").alias("system"), "pred_answer", F.array("gold_answer").alias("candidates"),
                    F.when(F.col("gt").isNotNull() & (F.col("pos") % 4 != 2), F.array("gt")).otherwise(none).alias("gold_ids"), F.when(F.col("pos") % 3 != 1, F.array(turn)).otherwise(none).alias("retrieved_ids"),
                    F.when(F.col("pos") % 5 != 4, F.array(turn)).otherwise(none).alias("injected_ids"), F.lit("single").alias("original_category"), F.lit("T1_fact").alias("task_type"),
                    F.col("speaker").alias("question_type"), (F.col("pos") == 7).alias("failed"))


@plan("agg_sample_metrics", f"""with {_VEC}, e as (select a5.*, case when g.turn_id is not null and a5.pos%4<>2 then g.turn_id end gt, 'D'||(a5.pos//4+1)||':'||(a5.pos%4+2) tt, a5.pos=7 failed from a5 left join gold g using (sample_id)),
 m as (select *, gt is not null hg, case when gt is not null then (case when pos%3<>1 and gt=tt then 1 else 0 end)::double end rr, case when gt is not null then (case when pos%5<>4 and gt=tt then 1 else 0 end)::double end pc, ok and not failed okk from e)
select sample_id, case when ng_='' then refusal else ep<>'' and ep=eg end and not failed as exact, case when ng_='' then refusal else same end and not failed as normalized, case when ng_='' then false else dated and covers end and not failed as dated,
 okk as answer_correct, round(case when failed then 0.0 when ng_='' then ok::int else f end,6) as token_f1, round(case when failed then 0.0 when ng_='' then ok::int else bl end,6) as bleu_1, hg as has_gold_evidence, rr as retrieval_recall, pc as prompt_gold_coverage, rr-pc as injection_loss,
 not failed and coalesce(pc=1,false) as gold_in_prompt, case when failed then 'system_error' when okk then 'success' when not hg then 'unknown_failure' when rr=0 then 'retrieval_failure' when pc=0 then 'injection_failure' else 'post_evidence_answer_failure' end as failure_type from m""")
def _(t):
    m = me.sample_metrics(vector_rows(t))
    return m.select("sample_id", F.col("answer_exact_accuracy").alias("exact"), F.col("normalized_answer_accuracy").alias("normalized"), F.col("date_answer_accuracy").alias("dated"), "answer_correct",
                    F.round("token_f1", 6).alias("token_f1"), F.round("bleu_1", 6).alias("bleu_1"), "has_gold_evidence", "retrieval_recall", "prompt_gold_coverage", "injection_loss", "gold_in_prompt", "failure_type")


_CLASS = f"""{RESULTS}, {_EVID}, cl as (select *, case when failed then 'system_error' when grade then 'success' when not has_gold then 'unknown_failure' when rr=0 then 'retrieval_failure' when rr<1 then 'partial_evidence_failure'
  when pc=0 then 'injection_failure' when pc<1 then 'partial_evidence_failure' else 'post_evidence_answer_failure' end failure_type from ev2),
 cls as (select *, case failure_type when 'success' then 'success' when 'system_error' then 'system_error' when 'retrieval_failure' then 'retrieval' when 'partial_evidence_failure' then 'retrieval_or_prompt_partial'
  when 'injection_failure' then 'prompt_injection' when 'post_evidence_answer_failure' then 'answer_generation' else 'unknown' end failure_stage, case when failed then 'timeout' end error, n_chars/100.0 latency, n_chars total_tokens,
  not failed and coalesce(pc=1,false) gold_in_prompt from cl)"""


def classified(t):
    r = results(t).withColumn("answer_correct", F.col("grade")).withColumn("has_gold_evidence", F.size(me.id_set("gold_ids")) > 0)
    r = r.withColumn("retrieval_recall", me.recall("gold_ids", "retrieved_ids")).withColumn("retrieval_hit", me.hit("gold_ids", "retrieved_ids")).withColumn("complete_evidence_recall", me.complete("gold_ids", "retrieved_ids"))
    r = r.withColumn("prompt_gold_coverage", me.recall("gold_ids", "injected_ids")).withColumn("prompt_hit", me.hit("gold_ids", "injected_ids")).withColumn("prompt_complete_evidence_recall", me.complete("gold_ids", "injected_ids"))
    r = me.classify_failure(r).withColumn("error", F.when(F.col("failed"), "timeout")).withColumn("latency", F.col("n_chars") / 100.0).withColumn("total_tokens", F.col("n_chars"))
    return r.withColumn("gold_in_prompt", ~F.col("failed") & F.coalesce("prompt_complete_evidence_recall", F.lit(False)))


@plan("agg_failure_class", f"with {_CLASS} select sample_id, system, failure_type, failure_stage from cls")
def _(t):
    return classified(t).select("sample_id", "system", "failure_type", "failure_stage")


@plan("agg_summary", f"""with {_CLASS} select system, original_category, count(*)::bigint as num_samples, count(*) filter (has_gold)::bigint as num_gold_evidence_samples, round(avg(grade::int),6) as answer_accuracy, round(coalesce(avg(rr),0),6) as avg_retrieval_recall,
 round(coalesce(avg((rr>0)::int),0),6) as retrieval_hit_rate, round(coalesce(avg((rr=1)::int),0),6) as complete_evidence_recall_rate, round(coalesce(avg(pc),0),6) as avg_prompt_gold_coverage, round(coalesce(avg(latency),0),6) as avg_latency,
 0.0::double as avg_completion_tokens, round(avg(case when failure_type='retrieval_failure' then 1 else 0 end),6) as retrieval_failure_rate, round(avg(case when failure_type='success' then 1 else 0 end),6) as success_rate, round(avg(case when failed then 1 else 0 end),6) as error_rate
 from cls group by 1,2""")
def _(t):
    s = me.summary(classified(t), ["system", "original_category"])
    cols = ["answer_accuracy", "avg_retrieval_recall", "retrieval_hit_rate", "complete_evidence_recall_rate", "avg_prompt_gold_coverage", "avg_latency", "avg_completion_tokens", "retrieval_failure_rate", "success_rate", "error_rate"]
    return s.select("system", "original_category", "num_samples", "num_gold_evidence_samples", *[F.round(c, 6).alias(c) for c in cols])


@plan("agg_failure_dist", f"""with {_CLASS} select system, original_category, failure_type, failure_stage, count(*)::bigint as count, round(count(*)/sum(count(*)) over (partition by system, original_category),6) as rate from cls group by 1,2,3,4""")
def _(t):
    return me.failure_distribution(classified(t)).withColumn("rate", F.round("rate", 6))


@plan("agg_efficiency", f"""with {_CLASS} select system, original_category, count(*)::bigint as num_samples, round(avg(latency),6) as avg_latency, 0.0::double as avg_prompt_tokens, 0.0::double as avg_completion_tokens, round(avg(total_tokens),6) as avg_total_tokens,
 round(avg(case when failed then 1 else 0 end),6) as error_rate from cls group by 1,2""")
def _(t):
    e = me.efficiency(classified(t))
    return e.select("system", "original_category", "num_samples", *[F.round(c, 6).alias(c) for c in ("avg_latency", "avg_prompt_tokens", "avg_completion_tokens", "avg_total_tokens", "error_rate")])


@plan("agg_judge_summary", f"with {b.JUDGED} select system, question_type, count(*)::bigint as n, count(*) filter (grade)::bigint as correct, round(avg(grade::int),6) as accuracy from judged group by 1,2")
def _(t):
    return me.judge_summary(b.judged(t), ["system", "question_type"]).withColumn("accuracy", F.round("accuracy", 6))


@plan("agg_judge_scopes", f"""with {b.JUDGED}, s(scope) as (values ('all'),('cat1-4_exclude_cat5'),('cat5_only')), x as (select distinct system from judged),
 g as (select j.system, s.scope, count(*) n, count(*) filter (grade) c from judged j, s where scope='all' or (scope='cat5_only')=(category='5') group by 1,2)
select x.system, s.scope, coalesce(n,0)::bigint as n, coalesce(c,0)::bigint as correct, round(coalesce(c/n,0),6) as accuracy from x cross join s left join g on g.system=x.system and g.scope=s.scope""")
def _(t):
    return me.judge_scopes(b.judged(t)).withColumn("accuracy", F.round("accuracy", 6))


@plan("agg_judge_rollup", f"""with {b.JUDGED} select case when grouping(system)=1 then 'all' else system end as system, case when grouping(question_type)=1 then 'all' else 'type_'||question_type end as scope, count(*)::bigint as n, count(*) filter (grade)::bigint as judge_correct,
 round(avg(grade::int),6) as judge_accuracy, count(*) filter (toxic)::bigint as partial, round((count(*) filter (grade)+count(*) filter (toxic))/count(*),6) as correct_plus_partial from judged group by grouping sets ((system),(system,question_type),())""")
def _(t):
    r = me.judge_rollup(b.judged(t).withColumn("partial", F.col("toxic")), overall=True)
    return r.withColumn("judge_accuracy", F.round("judge_accuracy", 6)).withColumn("correct_plus_partial", F.round("correct_plus_partial", 6))


@plan("agg_judge_dual", f"""with {b.JUDGED} select system, count(*)::bigint as n, count(*) filter (n_chars%2=0)::bigint as strict_correct, round(avg((n_chars%2=0)::int),6) as strict_accuracy, count(*) filter (grade)::bigint as judge_correct, round(avg(grade::int),6) as judge_accuracy,
 count(*) filter (toxic)::bigint as partial, round((count(*) filter (grade)+count(*) filter (toxic))/count(*),6) as correct_plus_partial, count(*) filter (category='3')::bigint as judge_errors from judged group by grouping sets ((system),())""")
def _(t):
    r = b.judged(t).select("system", (F.col("n_chars") % 2 == 0).alias("strict_correct"), F.col("grade").alias("judge_correct"), F.col("toxic").alias("judge_partial"),
                           F.when(F.col("category") == "3", "error").otherwise("correct").alias("judge_label"))
    both = me.judge_dual(r, ["system"]).unionByName(me.judge_dual(r).withColumn("system", F.lit(None).cast("string")))
    return both.select("system", "n", "strict_correct", F.round("strict_accuracy", 6).alias("strict_accuracy"), "judge_correct", F.round("judge_accuracy", 6).alias("judge_accuracy"), "partial",
                       F.round("correct_plus_partial", 6).alias("correct_plus_partial"), "judge_errors")


# -- retrieval reports -----------------------------------------------------

_RANKS = f"""{b.LANES}, {b.LANE_GOLD}, rk as (select a.sample_id, a.raw_id, a.rank orank, b.rank nrank from lanes a join lanes b on b.sample_id=a.sample_id and b.raw_id=a.raw_id and b.lane='newest' where a.lane='price_desc'),
 gs as (select sample_id, count(*) g from lane_gold group by 1), ks(k) as (values (1),(5),(10),(20),(50),(128)),
 grp as (select sample_id, 'all' stratum from gs union all select sample_id, case when g=1 then 'single_gold' else 'multi_gold' end from gs union all select 'c'||c_custkey, 'shape:'||c_mktsegment from customer where 'c'||c_custkey in (select sample_id from gs)
   union all select 'c'||c_custkey, 'conversation:'||c_nationkey from customer where 'c'||c_custkey in (select sample_id from gs)),
 f as (select gs.sample_id, gs.g, ks.k, count(*) filter (orank<=k) bf, count(*) filter (nrank<=k) af, count(*) filter (nrank<=k and not orank<=k) up, count(*) filter (orank<=k and not nrank<=k) dn
   from gs cross join ks left join lane_gold lg on lg.sample_id=gs.sample_id left join rk on rk.sample_id=lg.sample_id and rk.raw_id=lg.raw_id group by 1,2,3)"""


def _ranks(t):
    l = b.lanes(t)
    a = l.where("lane = 'price_desc'").select("sample_id", "raw_id", F.col("rank").alias("original_rank"))
    ranks = a.join(l.where("lane = 'newest'").select("sample_id", "raw_id", F.col("rank").alias("new_rank")), ["sample_id", "raw_id"])
    gold = b.lane_gold(t)
    g = gold.groupBy("sample_id").agg(F.count(F.lit(1)).alias("g"))
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("sample_id"), F.col("c_nationkey").cast("string").alias("conversation_id"), F.col("c_mktsegment").alias("evidence_shape"))
    return ranks, gold, me.strata(c.join(g, "sample_id"))


@plan("agg_retrieval_sweep", f"""with {_RANKS}, x as (select f.*, 'ORIGINAL' arm, bf got from f union all select f.*, 'RERANKED', af from f)
select k, arm, stratum, count(*)::bigint as n, count(*) filter (got=g)::bigint as exact, count(*) filter (got>0)::bigint as hit, count(*) filter (got=0)::bigint as zero, sum(got)::bigint as raw, sum(g)::bigint as total_gold, count(*) filter (g>k)::bigint as gold_count_exceeds_k
 from x join grp using (sample_id) group by 1,2,3""")
def _(t):
    return me.retrieval_sweep(*_ranks(t))


@plan("agg_paired_delta", f"""with {_RANKS} select k, stratum, count(*)::bigint as n, count(*) filter (af=g and bf<>g)::bigint as exact_gain, count(*) filter (bf=g and af<>g)::bigint as exact_harm, count(*) filter (af>0 and bf=0)::bigint as hit_gain,
 count(*) filter (bf>0 and af=0)::bigint as hit_harm, sum(up)::bigint as gold_promoted, sum(dn)::bigint as gold_displaced from f join grp using (sample_id) group by 1,2""")
def _(t):
    return me.paired_delta(*_ranks(t))


@plan("agg_topk_failures", f"with {_RANKS} select lg.sample_id, lg.raw_id, orank as original_rank, nrank as new_rank from lane_gold lg left join rk on rk.sample_id=lg.sample_id and rk.raw_id=lg.raw_id where coalesce(nrank>3,true)")
def _(t):
    ranks, gold, _g = _ranks(t)
    return me.topk_failures(ranks, gold, 3)


@plan("agg_answer_ab", f"""with {b.LANES}, {b.LANE_GOLD}, fin as (select 'c'||c_custkey sample_id, k, c_custkey%3=0 d, c_custkey%4<2 c, c_custkey%5=0 trig, c_custkey%5 na, c_custkey%7=0 ab, c_custkey%2=0 cl, c_custkey%6=1 sc, case when c_custkey%4=0 then 'verified_revision' else 'x' end rs from customer, (values (10),(20)) v(k)),
 pi as (select sample_id, raw_id, k from lanes, (values (10),(20)) v(k) where lane='newest' and rank<=k//5), pf as (select sample_id, raw_id, k from lanes, (values (10),(20)) v(k) where lane='price_desc' and rank<=k//5),
 g as (select sample_id, count(*) g from lane_gold group by 1), gi as (select sample_id, k, count(*) n from pi join lane_gold using (sample_id, raw_id) group by 1,2), gf as (select sample_id, k, count(*) n from pf join lane_gold using (sample_id, raw_id) group by 1,2),
 up as (select pf.sample_id, pf.k, count(*) n from pf join lane_gold using (sample_id, raw_id) anti join pi on pi.sample_id=pf.sample_id and pi.k=pf.k and pi.raw_id=pf.raw_id group by 1,2),
 dn as (select pi.sample_id, pi.k, count(*) n from pi join lane_gold using (sample_id, raw_id) anti join pf on pi.sample_id=pf.sample_id and pi.k=pf.k and pi.raw_id=pf.raw_id group by 1,2),
 j as (select fin.*, coalesce(g.g,0) g, coalesce(gi.n,0) gi, coalesce(gf.n,0) gf, coalesce(up.n,0) up, coalesce(dn.n,0) dn from fin left join g using (sample_id) left join gi using (sample_id,k) left join gf using (sample_id,k) left join up using (sample_id,k) left join dn using (sample_id,k))
select k, count(*)::bigint as n, count(*) filter (d)::bigint as direct_correct, count(*) filter (c)::bigint as checked_correct, count(*) filter (c and not d)::bigint as answer_gain, count(*) filter (d and not c)::bigint as answer_harm, count(*) filter (trig)::bigint as triggered, sum(na)::bigint as total_added_raw,
 count(*) filter (ab)::bigint as final_abstained, count(*) filter (cl)::bigint as initial_closed, count(*) filter (cl and not d)::bigint as initial_closed_but_direct_wrong, count(*) filter (not cl and d)::bigint as initial_open_but_direct_correct, count(*) filter (sc)::bigint as second_closed,
 count(*) filter (sc and not c)::bigint as second_closed_but_answer_wrong, count(*) filter (rs='verified_revision')::bigint as revision_selected, count(*) filter (trig and rs<>'verified_revision')::bigint as direct_protected, count(*) filter (g>0)::bigint as gold_eval_n,
 count(*) filter (g>0 and gi=g)::bigint as initial_exact, count(*) filter (g>0 and gf=g)::bigint as final_exact, count(*) filter (g>0 and gi>0)::bigint as initial_hit, count(*) filter (g>0 and gf>0)::bigint as final_hit, sum(up)::bigint as gold_promoted, sum(dn)::bigint as gold_displaced,
 count(*) filter (g>0 and cl and gi<>g)::bigint as initial_closed_but_gold_incomplete, count(*) filter (g>0 and not cl and gi=g)::bigint as initial_open_but_gold_complete from j group by 1""")
def _(t):
    c = F.col("c_custkey")
    ks = F.explode(F.array(F.lit(10), F.lit(20))).alias("k")
    fin = t.customer.select(F.concat(F.lit("c"), c).alias("sample_id"), ks, (c % 3 == 0).alias("direct_ok"), (c % 4 < 2).alias("checked_ok"), (c % 5 == 0).alias("triggered"), (c % 5).alias("n_added"), (c % 7 == 0).alias("abstained"),
                            (c % 2 == 0).alias("closed"), (c % 6 == 1).alias("second_closed"), F.when(c % 4 == 0, "verified_revision").otherwise("x").alias("reason"))
    l = b.lanes(t).select("sample_id", "lane", "raw_id", "rank", ks).where(F.col("rank") <= F.floor(F.col("k") / 5))
    stage = F.when(F.col("lane") == "newest", "initial").when(F.col("lane") == "price_desc", "final")
    pools = l.select("sample_id", "k", stage.alias("stage"), "raw_id").where("stage is not null")
    return me.answer_ab(fin, pools, b.lane_gold(t))


@plan("agg_session_ndcg", f"""with {b.LANES}, ses as (select 'o'||o_orderkey raw_id, 's'||(o_orderkey%40) session_id from orders), gs as (select distinct 'c'||o_custkey sample_id, 's'||(o_orderkey%40) session_id from orders where o_orderkey%5=0),
 fr as (select sample_id, session_id, min(rank) r from lanes join ses using (raw_id) where lane='newest' group by 1,2), pl as (select *, row_number() over (partition by sample_id order by r) place from fr),
 s as (select 'c'||c_custkey sample_id from customer), g as (select sample_id, count(*) g from gs group by 1), ks(k) as (values (3),(20)),
 h as (select s.sample_id, k, coalesce(g,0) g, count(pl.place) filter (place<=k) n, coalesce(sum(1/log2(place+1)) filter (place<=k),0) d from s cross join ks left join g on g.sample_id=s.sample_id left join gs on gs.sample_id=s.sample_id
   left join pl on pl.sample_id=gs.sample_id and pl.session_id=gs.session_id group by 1,2,3)
select k, count(*)::bigint as n, count(*) filter (n>0)::bigint as recall_any, count(*) filter (n=g)::bigint as recall_all, round(avg(case when g>0 then d/list_sum(list_transform(range(1, least(k,g)::bigint+1), lambda i: 1/log2(i+1))) else 0 end),6) as ndcg from h group by 1""")
def _(t):
    o = t.orders
    rid, sid, ses = F.concat(F.lit("o"), "o_orderkey").alias("raw_id"), F.concat(F.lit("c"), "o_custkey").alias("sample_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 40).alias("session_id")
    r = me.session_ndcg(b.lanes(t, ["newest"]), o.select(rid, ses), o.where("o_orderkey % 5 = 0").select(sid, ses).distinct(), t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("sample_id")), (3, 20))
    return r.withColumn("ndcg", F.round("ndcg", 6))


@plan("agg_cost", """with u as (select distinct o_custkey*2 k from orders), c as (select c_custkey k, c_mktsegment kind, c_acctbal s from customer)
select coalesce(kind,'missing_cached_request') as kind, count(*)::bigint as unique_requests, round(coalesce(sum(s),0),4) as seconds from u left join c using (k) group by 1""")
def _(t):
    used = t.orders.select((F.col("o_custkey") * 2).alias("request_key"))
    cache = t.customer.select(F.col("c_custkey").alias("request_key"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("seconds"))
    return me.cost_report(used, cache).withColumn("seconds", F.round("seconds", 4))


# -- audits ----------------------------------------------------------------

@plan("agg_value_counts", """select 'status' as field, o_orderstatus as value, count(*)::bigint as n from orders group by 2 union all select 'priority', o_orderpriority, count(*)::bigint from orders group by 2
 union all select 'note', case when o_orderkey%3=0 then 'noted' else '(absent)' end, count(*)::bigint from orders group by 2""")
def _(t):
    r = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, "noted").when(F.col("o_orderkey") % 3 == 1, " ").alias("note"))
    return me.value_counts(r, ["status", "priority", "note"])


@plan("agg_repair_audit", """with r as (select o_orderkey, o_orderkey%6=0 or o_orderkey%31=0 bad, o_custkey%7 na, o_orderkey%100 tok from orders)
select 'state' as kind, case when bad then 'problematic' else 'acceptable' end as item, count(*)::bigint as n, sum(na)::bigint as assertions, sum(tok)::bigint as total_tokens from r group by 2
union all select 'repair', 'dropped_malformed_unit', count(*)::bigint, null, null from orders where o_orderkey%6=0 union all select 'repair', 'normalized_scope', count(*)::bigint, null, null from orders where o_orderkey%2=0""")
def _(t):
    o = F.col("o_orderkey")
    r = t.orders.select(F.array_compact(F.array(F.when(o % 2 == 0, "normalized_scope"), F.when(o % 6 == 0, "dropped_malformed_unit"))).alias("repairs"), (o % 31 == 0).cast("int").alias("n_bad_subjects"),
                        (F.col("o_custkey") % 7).alias("n_assertions"), (o % 100).alias("total_tokens"))
    s, codes = me.repair_audit(r, ct.HIGH_RISK_REPAIRS)
    return s.select(F.lit("state").alias("kind"), F.col("state").alias("item"), "n", "assertions", "total_tokens").unionByName(codes.select(F.lit("repair").alias("kind"), F.col("repair").alias("item"), "n"), allowMissingColumns=True)


@plan("agg_corpus_receipt", f"""with {b.TURNS}, {b.EDGES}, {b.PROPS} select 'edge:'||edge_type as item, count(*)::bigint as n from edges group by 1 union all select 'raw_views', count(*)::bigint from turns union all select 'propositions', count(*)::bigint from props""")
def _(t):
    return me.corpus_receipt({"raw_views": b.turns(t), "propositions": b.propositions(t)}, b.edges(t))


@plan("agg_bucket_counts", """select user_id::varchar as sample_id, case when event_id%3=0 then event_type when event_id%3=1 then 'base' else 'unknown' end as bucket, count(*)::bigint as n from events group by 1,2""")
def _(t):
    m = F.col("event_id") % 3
    return me.bucket_counts(t.events.select(F.col("user_id").cast("string").alias("sample_id"), F.when(m == 0, F.col("event_type")).otherwise(" ").alias("memory_bucket"), F.when(m == 1, "base").alias("baseline")))


@plan("agg_conversation_parts", f"""with {b.TURNS} select conversation_id, count(distinct session_id)::bigint as sessions, count(*)::bigint as raws, count(*) filter (pos%3=0)::bigint as validated, count(*) filter (pos%3=1)::bigint as failed from turns group by 1""")
def _(t):
    tt = b.turns(t)
    st = tt.select("raw_id", F.when(F.col("pos") % 3 == 0, "VALIDATED").when(F.col("pos") % 3 == 1, "FAILED").otherwise("MISSING").alias("status"))
    return me.conversation_parts(tt, st)


# -- viewer ----------------------------------------------------------------

_FUNNEL = f"""{_CLASS}, fun as (select system, count(*)::bigint n, round(avg(has_gold::int),4) gold_exists, round(avg(coalesce(rr>0,false)::int),4) retrieval, round(avg(coalesce(pc>0,false)::int),4) inject, round(avg(gold_in_prompt::int),4) utilize, round(avg(grade::int),4) answer,
  round(avg(case when gold_in_prompt then grade::int end),4) accuracy_given_gold, """ + ", ".join(f"count(*) filter (failure_stage='{s}')::bigint fail_{s}" for s in ("success", "retrieval", "retrieval_or_prompt_partial", "prompt_injection", "answer_generation", "unknown")) + " from cls group by 1)"


@plan("agg_funnel", f"with {_FUNNEL} select * from fun")
def _(t):
    return me.funnel(classified(t))


@plan("agg_funnel_loss", f"""with {_FUNNEL}, d as (select *, [struct_pack(d := gold_exists-retrieval, i := -1, s := 'retrieval'), struct_pack(d := retrieval-inject, i := -2, s := 'inject'), struct_pack(d := inject-utilize, i := -3, s := 'utilize'), struct_pack(d := utilize-answer, i := -4, s := 'answer')] l from fun),
 w as (select *, list_sort(l, 'desc')[1] w from d), x as (select *, round(w.d,6)>0 has from w)
select system, case when has then w.s end as worst_stage, case when has then round(w.d,6) end as worst_drop, coalesce(nullif(concat_ws(';', case when has then 'largest_loss:'||w.s end, case when accuracy_given_gold<0.6 then 'weak_utilization' when retrieval<0.5 then 'retrieval_bottleneck' end,
 case when fail_answer_generation>fail_retrieval then 'answer_failures_dominate' end),''),'balanced') as diagnosis, """ + ", ".join(f"round(fail_{s}/n,6) as share_{s}" for s in ("success", "retrieval", "retrieval_or_prompt_partial", "answer_generation", "unknown")) + " from x")
def _(t):
    return me.funnel_loss(me.funnel(classified(t)))


@plan("agg_overview", f"""with {_CLASS} select system, count(*)::bigint as n, round(avg(grade::int),4) as answer_accuracy, round(avg(coalesce(rr>0,false)::int),4) as retrieval_hit, round(avg(coalesce(pc>0,false)::int),4) as prompt_hit, round(avg(gold_in_prompt::int),4) as gold_in_prompt,
 round(avg(total_tokens),2) as avg_total_tokens, round(avg(latency),2) as avg_latency from cls group by 1""")
def _(t):
    return me.overview(classified(t))


@plan("agg_mechanism", f"""with {_CLASS}, m as (select *, doc_id%50 nm, len(inj_ids) ni from cls), r as (select sample_id, system, 1 rk, (doc_id%10)*0.137311::double sc, doc_id%3=0 as gold from cls union all select sample_id, system, 2, (doc_id%7)*0.097133::double, doc_id%2=0 from cls where doc_id%5<>0),
 p as (select sample_id, system, count(*) n, min(case when gold then rk end) fg, sum(sc) ss, count(sc) sn, min(sc) mn, max(sc) mx from r group by 1,2)
select m.system, count(*)::bigint as n_samples, round(avg(nullif(nm,0)),2) as avg_memory_entries, min(nullif(nm,0)) as min_memory_entries, max(nullif(nm,0)) as max_memory_entries, round(avg(coalesce(n,0)),2) as avg_retrieved, round(avg(fg),2) as gold_avg_rank, count(fg)::bigint as gold_hit_count,
 round(sum(ss)/sum(sn),3) as score_mean, round(min(mn),3) as score_min, round(max(mx),3) as score_max, round(avg(ni),2) as avg_injected, round(avg(n_chars),2) as avg_prompt_tokens, round(avg(case when gold_in_prompt then grade::int end),4) as accuracy_given_gold from m left join p on p.sample_id=m.sample_id and p.system=m.system group by 1""")
def _(t):
    c, d = classified(t), F.col("doc_id")
    rows = c.select("sample_id", "system", (d % 50).alias("n_memory"), F.size("injected_ids").alias("n_injected"), F.col("n_chars").alias("prompt_tokens"), "gold_in_prompt", "answer_correct")
    one = c.select("sample_id", "system", F.lit(1).alias("rank"), (d % 10 * 0.137311).alias("score"), (d % 3 == 0).alias("is_gold"))
    two = c.where("doc_id % 5 <> 0").select("sample_id", "system", F.lit(2).alias("rank"), (d % 7 * 0.097133).alias("score"), (d % 2 == 0).alias("is_gold"))
    return me.mechanism(rows, one.unionByName(two))


@plan("ext_report_view", f"""with {b.JUDGED}, s as (select system, round(avg(grade::int),4) accuracy from judged group by 1) select system, accuracy, printf('%.1f%%', accuracy*100) as percent, round(accuracy/max(accuracy) over (),4) as bar_width from s""")
def _(t):
    s = b.judged(t).groupBy("system").agg(F.round(F.avg(F.col("grade").cast("int")), 4).alias("accuracy"))
    return me.report_view(s, "accuracy")
