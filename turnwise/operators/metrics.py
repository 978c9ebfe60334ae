"""Answer, evidence and report metrics. Means follow two conventions, named where they differ."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..functions.python_udfs import stem
from .joins import id_set
from .scale import top_k

#: Brevity-penalty base of the unsmoothed BLEU.
E = 2.718281828
# Failure stages and refusal phrases.
FAILURE_STAGE = {"success": "success", "system_error": "system_error", "retrieval_failure": "retrieval",
                 "partial_evidence_failure": "retrieval_or_prompt_partial", "injection_failure": "prompt_injection",
                 "post_evidence_answer_failure": "answer_generation", "abstention_or_hallucination_failure": "answer_generation",
                 "unknown_failure": "unknown"}
REFUSAL_PHRASES = ["not enough information", "not enough info", "insufficient information", "no answer", "unknown", "cannot be determined",
                   "cannot be answered", "no information", "not mentioned", "not available"]


def mean0(c: Column) -> Column:
    """Mean ignoring nulls, 0 where nothing is left (reports)."""
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def mean_null(c: Column) -> Column:
    """Mean ignoring nulls, null where nothing is left (diagnostics)."""
    return F.avg(c.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


# -- evidence --------------------------------------------------------------

def recall(gold, pred) -> Column:
    g, p = id_set(gold), id_set(pred)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, p)) / F.size(g))


def hit(gold, pred) -> Column:
    g, p = id_set(gold), id_set(pred)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, p)) > 0)


def complete(gold, pred) -> Column:
    g, p = id_set(gold), id_set(pred)
    return F.when(F.size(g) > 0, F.size(F.array_except(g, p)) == 0)


# -- token overlap ---------------------------------------------------------

def multiset_overlap(rows: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Per key: token counts of both sides and Σ min(count), linear in the text length.

    Tokens are counted per (key, token), so a very long text spreads over all tasks.
    """
    side = lambda c, x, y: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    each = rows.select(*keys, F.explode_outer(F.concat(side(a, 1, 0), side(b, 0, 1))).alias("t")).select(*keys, "t.*")
    per = each.groupBy(*keys, "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return per.groupBy(*keys).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_gold"),
                                  F.coalesce(F.sum(F.least("x", "y")), F.lit(0)).alias("overlap"))


def f1(both_empty: float = 1.0) -> Column:
    p, g, o = F.col("n_pred"), F.col("n_gold"), F.col("overlap")
    return (F.when((p == 0) & (g == 0), F.lit(both_empty)).when((p == 0) | (g == 0) | (o == 0), F.lit(0.0)).otherwise(2 * o / (p + g)))


def bleu(base: float = E, smooth: float = 0.0, both_empty: float = 1.0) -> Column:
    p, g, o = F.col("n_pred"), F.col("n_gold"), F.col("overlap")
    precision = F.when(o == 0, F.lit(smooth)).otherwise(o.cast("double")) / F.nullif(p, F.lit(0))
    penalty = F.when(p > g, F.lit(1.0)).otherwise(F.pow(F.lit(base), 1 - g / F.nullif(p, F.lit(0))))
    return F.when((p == 0) & (g == 0), F.lit(both_empty)).when((p == 0) | (g == 0), F.lit(0.0)).otherwise(penalty * precision)


def answer_tokens(c) -> Column:
    return tx.find_all(tx.normalize_for_match(c), r"[a-z0-9']+")


def token_f1(rows: DataFrame, keys: Sequence[str], pred="pred_answer", gold="gold_answer") -> DataFrame:
    return multiset_overlap(rows, keys, answer_tokens(pred), answer_tokens(gold)).withColumn("token_f1", f1())


def bleu1(rows: DataFrame, keys: Sequence[str], pred="pred_answer", gold="gold_answer") -> DataFrame:
    return multiset_overlap(rows, keys, answer_tokens(pred), answer_tokens(gold)).withColumn("bleu_1", bleu())


def word_tokens(c) -> Column:
    """Words and single punctuation marks: an approximation of a treebank tokenizer."""
    return tx.find_all(F.lower(tx.text_of(c)), r"(?U)[\w']+|[^\w\s]")


def bleu1_smoothed(rows: DataFrame, keys: Sequence[str], pred="pred_answer", gold="gold_answer") -> DataFrame:
    import math
    return multiset_overlap(rows, keys, word_tokens(pred), word_tokens(gold)).withColumn("bleu_1", bleu(math.e, 0.1, 0.0))


def set_f1(pred="pred_answer", gold="gold_answer") -> Column:
    """F1 over distinct words; `. , ! ?` separate."""
    words = lambda c: F.array_distinct(tx.find_all(F.translate(F.lower(tx.text_of(c)), ".,!?", "    "), r"\S+"))
    p, g = words(pred), words(gold)
    o = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (o == 0), F.lit(0.0)).otherwise(2 * o / (F.size(p) + F.size(g)))


PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def plain_words(c: Column) -> Column:
    """Lower case without punctuation and the words a, an, the, and."""
    s = F.regexp_replace(F.lower(F.replace(tx.text_of(c), F.lit(","), F.lit(""))), f"[{PUNCTUATION}]", "")
    return tx.find_all(F.regexp_replace(s, r"(?U)\b(a|an|the|and)\b", " "), r"\S+")


def category_f1(rows: DataFrame) -> DataFrame:
    """Stemmed F1 with category rules. rows: sample_id, category, pred_answer, gold_answer

    Category 3 reads the reference up to `;`; category 1 splits both sides at commas and averages
    each reference part's best match. Stems are computed once per distinct word.
    """
    gold = F.when(F.col("category") == "3", tx.strip(F.substring_index(tx.text_of("gold_answer"), ";", 1))).otherwise(tx.text_of("gold_answer"))
    parts = lambda c: F.when(F.col("category") == "1", F.transform(F.split(c, ","), tx.strip)).otherwise(F.array(c))
    cut = rows.select("sample_id", "category", parts(tx.text_of("pred_answer")).alias("ps"), parts(gold).alias("gs"))
    P = cut.select("sample_id", F.posexplode("ps").alias("pi", "p"))
    G = cut.select("sample_id", F.posexplode("gs").alias("gi", "g"))
    words = P.select(F.explode(plain_words(F.col("p"))).alias("w")).unionByName(G.select(F.explode(plain_words(F.col("g"))).alias("w"))).distinct()
    stems = words.withColumn("stem", stem("w"))
    count = lambda df, i, c: df.select("sample_id", i, F.explode(plain_words(F.col(c))).alias("w")).join(stems, "w").groupBy("sample_id", i, "stem").agg(F.count(F.lit(1)).alias("n"))
    np_, ng = count(P, "pi", "p").withColumnRenamed("n", "np"), count(G, "gi", "g").withColumnRenamed("n", "ng")
    common = np_.join(ng, ["sample_id", "stem"]).groupBy("sample_id", "pi", "gi").agg(F.sum(F.least("np", "ng")).alias("o"))
    lp, lg = np_.groupBy("sample_id", "pi").agg(F.sum("np").alias("lp")), ng.groupBy("sample_id", "gi").agg(F.sum("ng").alias("lg"))
    best = common.join(lp, ["sample_id", "pi"]).join(lg, ["sample_id", "gi"]).groupBy("sample_id", "gi").agg(F.max(2 * F.col("o") / (F.col("lp") + F.col("lg"))).alias("f"))
    return G.join(best, ["sample_id", "gi"], "left").groupBy("sample_id").agg(F.avg(F.coalesce("f", F.lit(0.0))).alias("category_f1"))


def lexical_report(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means per system and per (system, category) in one pass."""
    g = rows.groupingSets([["system"], ["system", "category"]], "system", "category").agg(
        F.grouping("category").alias("_g"), F.count(F.lit(1)).alias("n"), *[F.round(mean0(F.col(m)), 6).alias(m) for m in metrics])
    return g.withColumn("category", F.when(F.col("_g") == 1, "overall").otherwise(F.col("category"))).drop("_g")


# -- per sample ------------------------------------------------------------

def classify_failure(rows: DataFrame) -> DataFrame:
    """failure_type by ordered rules, and its stage. A null measure never counts as false."""
    label = F.lower(F.concat_ws(" ", tx.text_of("original_category"), tx.text_of("task_type"), tx.text_of("question_type")))
    unanswerable = F.contains(label, F.lit("adversarial")) | F.contains(label, F.lit("unanswerable"))
    r, c = F.coalesce("retrieval_recall", F.lit(0.0)), F.coalesce("prompt_gold_coverage", F.lit(0.0))
    kind = (F.when(F.coalesce(F.col("failed"), F.lit(False)), "system_error").when(F.col("answer_correct"), "success")
            .when(unanswerable, "abstention_or_hallucination_failure").when(F.lower(tx.strip(F.col("system"))) == "no_memory", "unknown_failure")
            .when(~F.col("has_gold_evidence"), "unknown_failure").when(r == 0, "retrieval_failure")
            .when(~F.coalesce("complete_evidence_recall", F.lit(True)), "partial_evidence_failure").when(c == 0, "injection_failure")
            .when(~F.coalesce("prompt_complete_evidence_recall", F.lit(True)) & (c > 0), "partial_evidence_failure")
            .when(F.coalesce("prompt_complete_evidence_recall", F.lit(False)), "post_evidence_answer_failure").otherwise("unknown_failure"))
    stage = F.create_map(*[F.lit(x) for kv in FAILURE_STAGE.items() for x in kv])
    return rows.withColumn("failure_type", kind).withColumn("failure_stage", F.coalesce(stage[F.col("failure_type")], F.lit("unknown")))


def sample_metrics(rows: DataFrame) -> DataFrame:
    """The whole metric vector of result rows.

    rows: sample_id, system, pred_answer, candidates array<string>, gold_ids, retrieved_ids, injected_ids,
    original_category, task_type, question_type, failed. One overlap aggregation feeds F1 and BLEU.
    """
    key = ["sample_id", "system"]
    pred = tx.canonicalize_answer("pred_answer")
    base = rows.withColumn("eval_pred", pred).withColumn("npred", tx.normalize_for_match("eval_pred")).withColumn(
        "cands", F.filter(F.transform("candidates", tx.canonicalize_answer), lambda x: tx.normalize_for_match(x) != ""))
    each = base.select(*key, "eval_pred", F.posexplode("cands").alias("ci", "cand"))
    ov = multiset_overlap(each, [*key, "ci"], answer_tokens("eval_pred"), answer_tokens("cand")).select(*key, f1().alias("f"), bleu().alias("b"))
    best = ov.groupBy(*key).agg(F.max("f").alias("f"), F.max("b").alias("b"))
    j = base.join(best, key, "left")
    none = F.size("cands") == 0
    norm = F.transform("cands", tx.normalize_for_match)
    refusal = F.when(F.col("npred") == "", True).otherwise(F.exists(F.array(*map(F.lit, REFUSAL_PHRASES)), lambda p: F.contains(F.col("npred"), p)))
    correction = F.size(tx.find_all(F.col("npred"), r"\S+")) > 5
    gold_dates = F.array_distinct(F.flatten(F.transform("cands", tx.extract_dates)))
    dates = tx.extract_dates("eval_pred")
    dated = (F.size(gold_dates) > 0) & (F.size(dates) > 0)
    covers = F.size(F.array_except(gold_dates, dates)) == 0
    exact = (F.col("eval_pred") != "") & F.exists("cands", lambda c: tx.normalize_text(c) == tx.normalize_text("eval_pred"))
    same = F.exists(norm, lambda c: c == F.col("npred"))
    inside = F.exists(norm, lambda c: F.contains(F.col("npred"), c))
    right = F.when(F.size(gold_dates) > 0, (same | inside | (dated & covers)) & ~(dated & ~covers)).otherwise(same | (F.col("f") >= 0.5) | inside)
    open_ok = refusal | correction
    pick = lambda empty, full: F.when(none, empty).otherwise(full)
    out = j.select(
        *rows.columns, pick(refusal, exact).alias("answer_exact_accuracy"), pick(refusal, same).alias("normalized_answer_accuracy"),
        pick(F.lit(False), dated & covers).alias("date_answer_accuracy"), pick(open_ok, right).alias("answer_correct"),
        pick(open_ok.cast("double"), F.col("f")).alias("token_f1"), pick(open_ok.cast("double"), F.col("b")).alias("bleu_1"),
        (F.size(id_set("gold_ids")) > 0).alias("has_gold_evidence"), recall("gold_ids", "retrieved_ids").alias("retrieval_recall"),
        hit("gold_ids", "retrieved_ids").alias("retrieval_hit"), complete("gold_ids", "retrieved_ids").alias("complete_evidence_recall"),
        recall("gold_ids", "injected_ids").alias("prompt_gold_coverage"), hit("gold_ids", "injected_ids").alias("prompt_hit"),
        complete("gold_ids", "injected_ids").alias("prompt_complete_evidence_recall"))
    bad = F.coalesce(F.col("failed"), F.lit(False))
    no = lambda c, v: F.when(bad, F.lit(v)).otherwise(F.col(c)).alias(c)
    out = out.withColumn("answer_correct", F.when(bad, False).otherwise(F.col("answer_correct"))).withColumn("token_f1", F.when(bad, 0.0).otherwise(F.col("token_f1"))).withColumn(
        "bleu_1", F.when(bad, 0.0).otherwise(F.col("bleu_1")))
    for c in ("answer_exact_accuracy", "normalized_answer_accuracy", "date_answer_accuracy"):
        out = out.withColumn(c, F.when(bad, False).otherwise(F.col(c)))
    out = out.withColumn("injection_loss", F.col("retrieval_recall") - F.col("prompt_gold_coverage")).withColumn(
        "gold_in_prompt", F.when(bad, False).otherwise(F.coalesce("prompt_complete_evidence_recall", F.lit(False))))
    out = out.withColumn("accuracy_given_gold_in_prompt", F.when(F.col("gold_in_prompt"), F.col("answer_correct"))).withColumn(
        "post_evidence_answer_failure", F.col("gold_in_prompt") & ~F.col("answer_correct"))
    return classify_failure(out)


# -- reports ---------------------------------------------------------------

SUMMARY_MEANS = {
    "answer_exact_accuracy": "answer_exact_accuracy", "normalized_answer_accuracy": "normalized_answer_accuracy", "date_answer_accuracy": "date_answer_accuracy",
    "answer_accuracy": "answer_correct", "avg_token_f1": "token_f1", "avg_bleu_1": "bleu_1", "avg_retrieval_recall": "retrieval_recall",
    "retrieval_hit_rate": "retrieval_hit", "complete_evidence_recall_rate": "complete_evidence_recall", "avg_prompt_gold_coverage": "prompt_gold_coverage",
    "prompt_hit_rate": "prompt_hit", "prompt_complete_evidence_recall_rate": "prompt_complete_evidence_recall", "avg_injection_loss": "injection_loss",
    "accuracy_given_gold_in_prompt": "accuracy_given_gold_in_prompt", "post_evidence_answer_failure_rate": "post_evidence_answer_failure",
    "avg_latency": "latency", "avg_prompt_tokens": "prompt_tokens", "avg_completion_tokens": "completion_tokens", "avg_total_tokens": "total_tokens"}
SUMMARY_FAILURES = {"retrieval_failure_rate": "retrieval_failure", "injection_failure_rate": "injection_failure", "utilization_failure_rate": "post_evidence_answer_failure",
                    "partial_evidence_failure_rate": "partial_evidence_failure", "abstention_or_hallucination_failure_rate": "abstention_or_hallucination_failure", "success_rate": "success"}


def summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """28 means and rates by any keys; columns a table lacks read 0."""
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    aggs = [F.count(F.lit(1)).alias("num_samples"), F.count_if(F.coalesce(col("has_gold_evidence"), F.lit(False))).alias("num_gold_evidence_samples")]
    aggs += [mean0(col(c)).alias(out) for out, c in SUMMARY_MEANS.items()]
    aggs += [ratio0(F.count_if(F.col("failure_type") == v), F.count(F.lit(1))).alias(out) for out, v in SUMMARY_FAILURES.items()]
    aggs += [mean0((tx.strip(tx.text_of(col("error"))) != "").cast("int")).alias("error_rate")]
    return rows.groupBy(*keys).agg(*aggs)


def failure_distribution(rows: DataFrame) -> DataFrame:
    """Count and share of each failure type within (system, category): the window sees one row per type."""
    g = rows.groupBy("system", "original_category", F.coalesce("failure_type", F.lit("unknown_failure")).alias("failure_type")).agg(F.count(F.lit(1)).alias("count"))
    stage = F.create_map(*[F.lit(x) for kv in FAILURE_STAGE.items() for x in kv])
    return g.withColumn("failure_stage", F.coalesce(stage[F.col("failure_type")], F.lit("unknown"))).withColumn(
        "rate", F.col("count") / F.sum("count").over(W.partitionBy("system", "original_category")))


def efficiency(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    return rows.groupBy("system", "original_category").agg(
        F.count(F.lit(1)).alias("num_samples"), *[mean0(col(c)).alias(f"avg_{c}") for c in ("latency", "prompt_tokens", "completion_tokens", "total_tokens")],
        mean0((tx.strip(tx.text_of("error")) != "").cast("int")).alias("error_rate"))


def judge_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("grade").alias("correct"), mean0(F.coalesce("grade", F.lit(False)).cast("int")).alias("accuracy"))


def judge_scopes(rows: DataFrame, with_cat5: bool = True) -> DataFrame:
    """Accuracy over all rows, categories 1–4, and category 5 alone, one pass."""
    five = F.col("category") == "5"
    scopes = F.array_compact(F.array(F.lit("all"), F.when(~five, "cat1-4_exclude_cat5"), F.when(five, "cat5_only") if with_cat5 else F.lit(None).cast("string")))
    got = rows.select("system", "grade", F.explode(scopes).alias("scope")).groupBy("system", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if("grade").alias("correct"))
    names = ["all", "cat1-4_exclude_cat5"] + (["cat5_only"] if with_cat5 else [])
    every = rows.select("system").distinct().select("system", F.explode(F.array(*map(F.lit, names))).alias("scope"))
    j = every.join(got, ["system", "scope"], "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("correct", F.lit(0))
    return j.select("system", "scope", n.alias("n"), c.alias("correct"), ratio0(c, n).alias("accuracy"))


def judge_rollup(rows: DataFrame, overall: bool = False) -> DataFrame:
    """(system, all) and (system, type_x) by grouping sets; with `overall` also the grand total."""
    sets = [["system"], ["system", "question_type"]] + ([[]] if overall else [])
    g = rows.groupingSets(sets, "system", "question_type").agg(
        F.grouping("system").alias("_s"), F.grouping("question_type").alias("_t"), F.count(F.lit(1)).alias("n"), F.count_if("grade").alias("judge_correct"), F.count_if("partial").alias("partial"))
    return g.select(F.when(F.col("_s") == 1, "all").otherwise(F.col("system")).alias("system"), F.when(F.col("_t") == 1, "all").otherwise(F.concat(F.lit("type_"), "question_type")).alias("scope"),
                    "n", "judge_correct", ratio0(F.col("judge_correct"), F.col("n")).alias("judge_accuracy"), "partial",
                    ratio0(F.col("judge_correct") + F.col("partial"), F.col("n")).alias("correct_plus_partial"))


def judge_dual(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Strict and judged accuracy side by side; no keys = one global row."""
    n = F.count(F.lit(1))
    s, j, p = F.count_if("strict_correct"), F.count_if("judge_correct"), F.count_if("judge_partial")
    return rows.groupBy(*keys).agg(n.alias("n"), s.alias("strict_correct"), ratio0(s, n).alias("strict_accuracy"), j.alias("judge_correct"), ratio0(j, n).alias("judge_accuracy"),
                                   p.alias("partial"), ratio0(j + p, n).alias("correct_plus_partial"), F.count_if(F.col("judge_label") == "error").alias("judge_errors"))


# -- retrieval reports -----------------------------------------------------

SWEEP = (1, 5, 10, 20, 50, 128)


def _found(ranks: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per (sample, k): gold size and gold found by each arm. ranks: sample_id, raw_id, original_rank, new_rank"""
    size = gold.groupBy("sample_id").agg(F.count(F.lit(1)).alias("g"))
    pos = gold.join(ranks, ["sample_id", "raw_id"])
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    at = []
    for k in ks:
        a, b = within("original_rank", k), within("new_rank", k)
        at += [F.count_if(a).alias(f"a{k}"), F.count_if(b).alias(f"b{k}"), F.count_if(b & ~a).alias(f"u{k}"), F.count_if(a & ~b).alias(f"d{k}")]
    per = size.join(pos.groupBy("sample_id").agg(*at), "sample_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.coalesce(f"{x}{k}", F.lit(0)).alias(y) for x, y in (("a", "before"), ("b", "after"), ("u", "up"), ("d", "down"))]) for k in ks]))
    return per.select("sample_id", "g", each.alias("x")).select("sample_id", "g", "x.*")


def strata(samples: DataFrame) -> DataFrame:
    """Groups a sample is reported under. samples: sample_id, conversation_id, evidence_shape, g"""
    return samples.select("sample_id", F.explode(F.array(F.lit("all"), F.when(F.col("g") == 1, "single_gold").otherwise("multi_gold"), F.concat(F.lit("shape:"), "evidence_shape"),
                                                         F.concat(F.lit("conversation:"), "conversation_id"))).alias("stratum"))


def retrieval_sweep(ranks: DataFrame, gold: DataFrame, groups: DataFrame, ks: Sequence[int] = SWEEP) -> DataFrame:
    """n, exact, hit, zero, raw, total gold and gold beyond k for each (k, arm, stratum); samples without gold are left out.

    groups: sample_id, stratum
    """
    f = _found(ranks, gold, ks)
    arms = F.explode(F.array(F.struct(F.lit("ORIGINAL").alias("arm"), F.col("before").alias("got")), F.struct(F.lit("RERANKED").alias("arm"), F.col("after").alias("got")))).alias("x")
    r = f.select("sample_id", "g", "k", arms).select("sample_id", "g", "k", "x.*").join(groups, "sample_id")
    return r.groupBy("k", "arm", "stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("g")).alias("exact"), F.count_if(F.col("got") > 0).alias("hit"), F.count_if(F.col("got") == 0).alias("zero"),
        F.sum("got").alias("raw"), F.sum("g").alias("total_gold"), F.count_if(F.col("g") > F.col("k")).alias("gold_count_exceeds_k"))


def paired_delta(ranks: DataFrame, gold: DataFrame, groups: DataFrame, ks: Sequence[int] = SWEEP) -> DataFrame:
    """Gains and harms between the two rankings of the same pool."""
    r = _found(ranks, gold, ks).join(groups, "sample_id")
    ea, eb = F.col("before") == F.col("g"), F.col("after") == F.col("g")
    ha, hb = F.col("before") > 0, F.col("after") > 0
    return r.groupBy("k", "stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(eb & ~ea).alias("exact_gain"), F.count_if(ea & ~eb).alias("exact_harm"),
                                         F.count_if(hb & ~ha).alias("hit_gain"), F.count_if(ha & ~hb).alias("hit_harm"), F.sum("up").alias("gold_promoted"), F.sum("down").alias("gold_displaced"))


def topk_failures(ranks: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Gold missing from the re-ranked top k, with both ranks."""
    j = gold.join(ranks, ["sample_id", "raw_id"], "left")
    return j.where(F.coalesce(F.col("new_rank") > k, F.lit(True))).select("sample_id", "raw_id", "original_rank", "new_rank")


def answer_ab(final: DataFrame, pools: DataFrame, gold: DataFrame) -> DataFrame:
    """Direct against checked answers per k.

    final: sample_id, k, direct_ok, checked_ok, triggered, n_added, abstained, closed, second_closed, reason;
    pools: sample_id, k, stage (initial / final), raw_id; gold: sample_id, raw_id
    """
    size = gold.groupBy("sample_id").agg(F.count(F.lit(1)).alias("g"))
    got = pools.join(gold, ["sample_id", "raw_id"]).groupBy("sample_id", "k", "raw_id").agg(F.max((F.col("stage") == "initial").cast("int")).alias("i"), F.max((F.col("stage") == "final").cast("int")).alias("f"))
    per = got.groupBy("sample_id", "k").agg(F.sum("i").alias("gi"), F.sum("f").alias("gf"), F.count_if((F.col("f") == 1) & (F.col("i") == 0)).alias("up"), F.count_if((F.col("i") == 1) & (F.col("f") == 0)).alias("down"))
    j = final.join(size, "sample_id", "left").join(per, ["sample_id", "k"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    has, n = z("g") > 0, F.count_if
    d, c = F.col("direct_ok"), F.col("checked_ok")
    exact_i, exact_f = z("gi") == F.col("g"), z("gf") == F.col("g")
    return j.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), n(d).alias("direct_correct"), n(c).alias("checked_correct"), n(c & ~d).alias("answer_gain"), n(d & ~c).alias("answer_harm"), n("triggered").alias("triggered"),
        F.sum("n_added").alias("total_added_raw"), n("abstained").alias("final_abstained"), n("closed").alias("initial_closed"), n(F.col("closed") & ~d).alias("initial_closed_but_direct_wrong"),
        n(~F.col("closed") & d).alias("initial_open_but_direct_correct"), n(F.coalesce("second_closed", F.lit(False))).alias("second_closed"),
        n(F.coalesce("second_closed", F.lit(False)) & ~c).alias("second_closed_but_answer_wrong"), n(F.col("reason") == "verified_revision").alias("revision_selected"),
        n(F.col("triggered") & (F.col("reason") != "verified_revision")).alias("direct_protected"), n(has).alias("gold_eval_n"), n(has & exact_i).alias("initial_exact"), n(has & exact_f).alias("final_exact"),
        n(has & (z("gi") > 0)).alias("initial_hit"), n(has & (z("gf") > 0)).alias("final_hit"), F.sum(z("up")).alias("gold_promoted"), F.sum(z("down")).alias("gold_displaced"),
        n(has & F.col("closed") & ~exact_i).alias("initial_closed_but_gold_incomplete"), n(has & ~F.col("closed") & exact_i).alias("initial_open_but_gold_complete"))


def session_ndcg(ranking: DataFrame, sessions: DataFrame, gold: DataFrame, samples: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    """Session-level any / all / NDCG@k: a session takes the place of its first record.

    ranking: sample_id, raw_id, rank; sessions: raw_id, session_id; gold: sample_id, session_id; samples: sample_id
    An empty gold set counts as fully recalled and scores 0.
    """
    first = ranking.join(sessions, "raw_id").groupBy("sample_id", "session_id").agg(F.min("rank").alias("r"))
    placed = top_k(first, ["sample_id"], [F.asc("r")], max(ks), "place")
    g = gold.groupBy("sample_id").agg(F.count(F.lit(1)).alias("g"))
    hits = placed.join(gold, ["sample_id", "session_id"])
    gain = 1 / F.log2(F.col("place") + 1)
    per = hits.groupBy("sample_id").agg(*[x for k in ks for x in (F.count_if(F.col("place") <= k).alias(f"n{k}"), F.sum(F.when(F.col("place") <= k, gain)).alias(f"d{k}"))])
    j = samples.select("sample_id").join(g, "sample_id", "left").join(per, "sample_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"n{k}", F.lit(0)).alias("n"), F.coalesce(f"d{k}", F.lit(0.0)).alias("d")) for k in ks])).alias("x")
    e = j.select("sample_id", F.coalesce("g", F.lit(0)).alias("g"), each).select("sample_id", "g", "x.*")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("k").cast("bigint"), F.col("g")), F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 0).alias("recall_any"), F.count_if(F.col("n") == F.col("g")).alias("recall_all"),
                              F.avg(F.when(F.col("g") > 0, F.col("d") / ideal).otherwise(0.0)).alias("ndcg"))


def cost_report(used: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct request keys by kind, seconds summed once per key, and keys absent from the cache.

    used: request_key; cache: request_key, kind, seconds
    """
    j = used.select("request_key").distinct().join(cache.dropDuplicates(["request_key"]), "request_key", "left")
    return j.groupBy(F.coalesce("kind", F.lit("missing_cached_request")).alias("kind")).agg(F.count(F.lit(1)).alias("unique_requests"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))


# -- audits ----------------------------------------------------------------

def value_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How often each value of each field occurs; blank counts as absent."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return rows.select(pairs).select("x.*").groupBy("field", F.coalesce(tx.nonblank("value"), F.lit("(absent)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def repair_audit(rows: DataFrame, high_risk: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Records acceptable or problematic with totals, and how often each repair was made.

    rows: repairs array<string>, n_bad_subjects, n_assertions, total_tokens
    """
    risky = F.size(F.array_intersect("repairs", F.array(*map(F.lit, high_risk)))) > 0
    kind = F.when(risky | (F.col("n_bad_subjects") > 0), "problematic").otherwise("acceptable").alias("state")
    s = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum("n_assertions").alias("assertions"), F.sum("total_tokens").alias("total_tokens"))
    codes = rows.select(F.explode(F.array_distinct("repairs")).alias("repair")).groupBy("repair").agg(F.count(F.lit(1)).alias("n"))
    return s, codes


def corpus_receipt(tables: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Row count per table and per edge type."""
    out = edges.groupBy(F.concat(F.lit("edge:"), "edge_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n"))
    return out


def bucket_counts(entries: DataFrame) -> DataFrame:
    """Memory buckets per sample. entries: sample_id, memory_bucket, baseline"""
    b = F.coalesce(tx.nonblank("memory_bucket"), tx.nonblank("baseline"), F.lit("unknown"))
    return entries.groupBy("sample_id", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def conversation_parts(turns: DataFrame, status: DataFrame) -> DataFrame:
    """Sessions, raws and raws by status per conversation. status: raw_id, status"""
    j = turns.select("conversation_id", "session_id", "raw_id").join(status, "raw_id", "left")
    return j.groupBy("conversation_id").agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("raws"),
                                            F.count_if(F.col("status") == "VALIDATED").alias("validated"), F.count_if(F.col("status") == "FAILED").alias("failed"))


# -- viewer tables ---------------------------------------------------------

STAGES = ("gold_exists", "retrieval", "inject", "utilize", "answer")


def funnel(rows: DataFrame) -> DataFrame:
    """Stage retention per system, accuracy given full evidence, and failures by stage as columns."""
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 4)
    n = F.count(F.lit(1))
    given = F.round(F.avg(F.when(F.col("gold_in_prompt"), F.col("answer_correct").cast("double"))), 4)
    stage = lambda s: F.count_if(F.col("failure_stage") == s).alias(f"fail_{s}")
    return rows.groupBy("system").agg(n.alias("n"), rate("has_gold_evidence").alias("gold_exists"), rate("retrieval_hit").alias("retrieval"), rate("prompt_hit").alias("inject"),
                                      rate("gold_in_prompt").alias("utilize"), rate("answer_correct").alias("answer"), given.alias("accuracy_given_gold"),
                                      *[stage(s) for s in ("success", "retrieval", "retrieval_or_prompt_partial", "prompt_injection", "answer_generation", "unknown")])


def funnel_loss(f: DataFrame) -> DataFrame:
    """Worst stage-to-stage drop and the bottleneck reading of a funnel."""
    drops = F.array(*[F.struct((F.col(a) - F.col(b)).alias("drop"), F.lit(-i).alias("i"), F.lit(b).alias("stage")) for i, (a, b) in enumerate(zip(STAGES, STAGES[1:]), 1)])
    worst = F.array_max(drops)
    has = F.round(worst["drop"], 6) > 0
    labels = F.array_compact(F.array(
        F.when(has, F.concat(F.lit("largest_loss:"), worst["stage"])),
        F.when(F.col("accuracy_given_gold") < 0.6, "weak_utilization").when(F.coalesce("retrieval", F.lit(0.0)) < 0.5, "retrieval_bottleneck"),
        F.when(F.col("fail_answer_generation") > F.col("fail_retrieval"), "answer_failures_dominate")))
    return f.select("system", F.when(has, worst["stage"]).alias("worst_stage"), F.when(has, F.round(worst["drop"], 6)).alias("worst_drop"),
                    F.when(F.size(labels) > 0, F.array_join(labels, ";")).otherwise("balanced").alias("diagnosis"),
                    *[F.round(F.col(f"fail_{s}") / F.col("n"), 6).alias(f"share_{s}") for s in ("success", "retrieval", "retrieval_or_prompt_partial", "answer_generation", "unknown")])


def overview(rows: DataFrame) -> DataFrame:
    """Leaderboard row per system."""
    rate = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 4)
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), rate("answer_correct").alias("answer_accuracy"), rate("retrieval_hit").alias("retrieval_hit"), rate("prompt_hit").alias("prompt_hit"),
                                      rate("gold_in_prompt").alias("gold_in_prompt"), F.round(F.avg("total_tokens"), 2).alias("avg_total_tokens"), F.round(F.avg("latency"), 2).alias("avg_latency")
                                      ).orderBy(F.desc("answer_accuracy"), F.asc("system"))


def mechanism(rows: DataFrame, retrieved: DataFrame) -> DataFrame:
    """How a system builds, retrieves and injects.

    rows: sample_id, system, n_memory, n_injected, prompt_tokens, gold_in_prompt, answer_correct;
    retrieved: sample_id, system, rank, score, is_gold — long, so no list is walked per row.
    """
    per = retrieved.groupBy("sample_id", "system").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_gold"),
                                                       F.sum("score").alias("ss"), F.count("score").alias("sn"), F.min("score").alias("smin"), F.max("score").alias("smax"))
    j = rows.join(per, ["sample_id", "system"], "left")
    mem = F.when(F.col("n_memory") > 0, F.col("n_memory"))
    return j.groupBy("system").agg(
        F.count(F.lit(1)).alias("n_samples"), F.round(F.avg(mem), 2).alias("avg_memory_entries"), F.min(mem).alias("min_memory_entries"), F.max(mem).alias("max_memory_entries"),
        F.round(F.avg(F.coalesce("n", F.lit(0))), 2).alias("avg_retrieved"), F.round(F.avg("first_gold"), 2).alias("gold_avg_rank"), F.count("first_gold").alias("gold_hit_count"),
        F.round(F.try_divide(F.sum("ss"), F.sum("sn")), 3).alias("score_mean"), F.round(F.min("smin"), 3).alias("score_min"), F.round(F.max("smax"), 3).alias("score_max"),
        F.round(F.avg("n_injected"), 2).alias("avg_injected"), F.round(F.avg("prompt_tokens"), 2).alias("avg_prompt_tokens"),
        F.round(F.avg(F.when(F.col("gold_in_prompt"), F.col("answer_correct").cast("double"))), 4).alias("accuracy_given_gold"))


def report_view(rows: DataFrame, value: str) -> DataFrame:
    """Percentage text and bar width against the largest value."""
    top = rows.agg(F.max(value).alias("_m"))
    return rows.crossJoin(F.broadcast(top)).withColumn("percent", F.concat(F.format_number(F.col(value) * 100, 1), F.lit("%"))).withColumn(
        "bar_width", F.round(F.coalesce(F.try_divide(F.col(value), F.col("_m")), F.lit(0.0)), 4)).drop("_m")
