"""Joins that hydrate, reconcile and trace evidence back to source turns."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from ..session import cut_lineage
from .blocked import block_pairs
from .matching import contains_pairs, overlap_pairs
from .scale import top_k

SCOPE = "conversation_id"


def hydrate(preds: DataFrame, questions: DataFrame, keys: Sequence[str] = ("sample_id",)):
    """Predictions with their question and gold; the canonical table wins, the row's own value fills in.

    Returns the hydrated rows and the rows still lacking a question or a gold answer.
    """
    q = questions.select(*keys, F.col("question").alias("_q"), F.col("gold_answer").alias("_g"), F.col("question_type").alias("_t"))
    j = preds.join(q, list(keys), "left")
    own = lambda c: F.col(c) if c in preds.columns else F.lit(None).cast("string")
    rows = j.select(*[c for c in preds.columns if c not in ("question", "gold_answer", "question_type")],
                    F.coalesce(tx.nonblank("_q"), own("question")).alias("question"), F.coalesce(tx.nonblank("_g"), own("gold_answer")).alias("gold_answer"),
                    F.coalesce(tx.nonblank("_t"), own("question_type")).alias("question_type"))
    lacks = F.array_compact(F.array(F.when(tx.nonblank("question").isNull(), "question"), F.when(tx.nonblank("gold_answer").isNull(), "gold_answer")))
    return rows, rows.withColumn("missing", lacks).where(F.size("missing") > 0)


def pending(samples: DataFrame, results: DataFrame, keys: Sequence[str] = ("sample_id", "system")) -> DataFrame:
    """Work without a finished result; a result with an error is not finished."""
    done = results.where(tx.strip(tx.text_of("error")) == "").select(*keys)
    return samples.join(done, list(keys), "left_anti")


def pending_changed(rows: DataFrame, judged: DataFrame, keys: Sequence[str] = ("system", "sample_id")) -> DataFrame:
    """Unjudged rows, and rows whose answer no longer reads like the judged one."""
    j = rows.join(judged.select(*keys, F.col("pred_answer").alias("_old"), F.lit(True).alias("_seen")), list(keys), "left")
    changed = tx.normalize_answer("pred_answer") != tx.normalize_answer("_old")
    return j.where(F.col("_seen").isNull() | changed).withColumn("why", F.when(F.col("_seen").isNull(), "unjudged").otherwise("changed")).drop("_old", "_seen")


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], error: Column | None = None) -> DataFrame:
    """One row: counts of expected, actual, missing, unexpected, duplicate and failed keys, and whether all is well."""
    err = F.max(error.cast("int")) if error is not None else F.max(F.lit(0))
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    a = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), err.alias("_err"))
    j = e.join(a, list(keys), "full_outer")
    s = j.agg(F.count("_e").alias("expected"), F.count("_n").alias("actual"), F.count_if(F.col("_n").isNull()).alias("missing"),
              F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("duplicates"), F.count_if(F.col("_err") > 0).alias("errors"))
    return s.withColumn("valid", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicates") == 0) & (F.col("errors") == 0))


def discrepancies(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The missing and unexpected keys themselves."""
    m = expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti").withColumn("kind", F.lit("missing"))
    u = actual.select(*keys).distinct().join(expected.select(*keys), list(keys), "left_anti").withColumn("kind", F.lit("unexpected"))
    return m.unionByName(u)


def merge_shards(order: DataFrame, shards: Sequence[DataFrame], key: str):
    """Shard rows in request order, plus the ids met twice and the ids met nowhere.

    order: key, request_no
    """
    rows = None
    for i, s in enumerate(shards):
        s = s.withColumn("shard", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    missing = order.join(rows.select(key), key, "left_anti")
    return rows.join(order, key), twice, missing


def id_space(turns: DataFrame) -> DataFrame:
    """Every id a citation may use, with the first turn that carries it as turn id or session id."""
    both = F.array(F.struct(F.col("turn_id").alias("id"), F.lit(0).alias("k")), F.struct(F.col("session_id").alias("id"), F.lit(1).alias("k")))
    t = turns.select(SCOPE, "pos", "turn_id", "session_id", F.explode(both).alias("x"))
    return t.where(tx.normalize_text(F.col("x.id")) != "").groupBy(SCOPE, tx.normalize_text(F.col("x.id")).alias("source_id")).agg(
        F.min_by(F.struct("pos", "turn_id", "session_id"), F.struct("pos", "x.k")).alias("t")).select(SCOPE, "source_id", "t.*")


def evidence_units(gold: DataFrame, turns: DataFrame) -> DataFrame:
    """Gold ids with the text, session and turn of the first history row they name.

    gold: sample_id, scope, source_id
    """
    j = gold.join(id_space(turns), [SCOPE, "source_id"], "left").join(turns.select(SCOPE, "pos", "text"), [SCOPE, "pos"], "left")
    return j.select("sample_id", SCOPE, "source_id", F.coalesce(tx.strip(F.col("text")), F.lit("")).alias("text"), F.coalesce("session_id", F.lit("")).alias("session_id"),
                    F.coalesce("turn_id", F.lit("")).alias("turn_id"), F.col("pos").isNotNull().alias("source_mapping_available"))


def key_evidence_units(samples: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence units in order: the explicit list, else the required facts' values, else every fact's value.

    samples: sample_id, parent_id, key_evidence_units, required_fact_ids; facts: parent_id, fact_id, ord, value
    """
    clean = F.filter(F.transform("key_evidence_units", tx.strip), lambda x: x != "")
    explicit = samples.select("sample_id", F.posexplode(clean).alias("o", "unit"))
    rest = samples.where(F.coalesce(F.size(clean), F.lit(0)) <= 0)
    named = rest.select("sample_id", "parent_id", F.posexplode("required_fact_ids").alias("o", "fact_id"))
    val = facts.where(tx.strip(tx.text_of("value")) != "").select("parent_id", "fact_id", F.col("ord"), "value")
    required = named.join(val, ["parent_id", "fact_id"]).select("sample_id", "o", F.col("value").alias("unit"))
    bare = rest.join(required.select("sample_id"), "sample_id", "left_anti").select("sample_id", "parent_id")
    every = bare.join(val, "parent_id").select("sample_id", F.col("ord").cast("int").alias("o"), tx.strip(F.col("value")).alias("unit"))
    return explicit.unionByName(required).unionByName(every)


# -- source inference ------------------------------------------------------

ID_PATTERN = r"(?i)\bD\d+:\d+\b|\bsession_\d+\b"
LIST_PATTERN = r"(?i)\b(?:source_turn_ids?|source_ids?|turn_ids?|session_ids?)\s*[:=]\s*([^;\]\)\n]+)"


def explicit_ids(texts: DataFrame, turns: DataFrame) -> DataFrame:
    """Ids written in a text that exist in its conversation, numbered in order of mention.

    texts: text_id, scope, text
    """
    free = tx.find_all(tx.text_of("text"), ID_PATTERN)
    lists = F.flatten(F.transform(tx.find_all(tx.text_of("text"), LIST_PATTERN, 1), lambda s: F.split(s, r"[\s,;]+")))
    cand = F.transform(F.concat(free, lists), lambda c: tx.normalize_text(F.btrim(c, F.lit("[](){}'\".,;"))))
    c = texts.select("text_id", SCOPE, F.posexplode(cand).alias("o", "source_id")).where("source_id <> ''").groupBy("text_id", SCOPE, "source_id").agg(F.min("o").alias("o"))
    return c.join(id_space(turns).select(SCOPE, "source_id"), [SCOPE, "source_id"], "left_semi")


#: Scopes of at most this many (text, turn) pairs, and rows of either side, are compared pair by pair.
DIRECT_PAIRS, DIRECT_ROWS = 1 << 21, 1 << 14


def text_turn_pairs(texts: DataFrame, turns: DataFrame, coverage: float = 0.85) -> DataFrame:
    """(text, turn) pairs: either holds the other's normalised text, or the text covers 85 % of the turn's words.

    Texts and turns of a bounded scope meet once and nothing but the pairs found leaves that join; the words of larger scopes
    are spread out and joined on.
    """
    distinct_words = lambda c: F.size(F.array_distinct(F.split(c, " ")))
    # read several times below: normalised once and written
    t = cut_lineage(texts.select(SCOPE, "text_id", tx.normalize_for_source_match("text").alias("t")).where("t <> ''").withColumn("tn", distinct_words("t")))
    u = cut_lineage(turns.select(SCOPE, "pos", tx.normalize_for_source_match("text").alias("u")).where("u <> ''").withColumn("un", distinct_words("u")))
    n = t.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("nt")).join(u.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("nu")), SCOPE)
    large = cut_lineage(n.where((F.col("nt") * F.col("nu") > DIRECT_PAIRS) | (F.greatest("nt", "nu") > DIRECT_ROWS)).select(SCOPE))
    need = F.greatest(F.ceil(F.col("un") * coverage - 1e-9), F.lit(1))
    covers = (F.col("tn") >= need) & (F.size(F.array_intersect(F.split("u", " "), F.split("t", " "))) >= need)
    some = not large.isEmpty()
    few = lambda df: df.join(F.broadcast(large), SCOPE, "left_anti") if some else df
    direct = few(t).join(few(u), SCOPE).where(F.contains("t", F.col("u")) | F.contains("u", F.col("t")) | covers).select(SCOPE, "text_id", "pos")
    if not some:
        return direct.distinct()
    t, u = (df.join(F.broadcast(large), SCOPE, "left_semi") for df in (t, u))
    held = contains_pairs(u.withColumnRenamed("u", "nt"), t.withColumnRenamed("t", "ht"), [SCOPE], "pos", "text_id").select(SCOPE, "text_id", "pos")
    holds = contains_pairs(t.withColumnRenamed("t", "nt"), u.withColumnRenamed("u", "ht"), [SCOPE], "text_id", "pos").select(SCOPE, "text_id", "pos")
    # each way of matching is a plan of its own: the driver holds one at a time
    direct, held, holds = cut_lineage(direct), cut_lineage(held), cut_lineage(holds)
    cover = overlap_pairs(u.select(SCOPE, "pos", F.split("u", " ").alias("lw")), t.select(SCOPE, "text_id", F.split("t", " ").alias("rw")),
                          [SCOPE], "pos", "text_id", coverage).select(SCOPE, "text_id", "pos")
    return direct.unionByName(held).unionByName(holds).unionByName(cover).distinct()


def infer_sources(texts: DataFrame, turns: DataFrame) -> DataFrame:
    """Source ids of a text in order: ids written in it, then turn and session id of each matching turn."""
    said = explicit_ids(texts, turns).select("text_id", SCOPE, "source_id", F.struct(F.lit(0).alias("k"), F.col("o").cast("bigint").alias("a"), F.lit(0).alias("b")).alias("o"))
    m = text_turn_pairs(texts, turns).join(turns.select(SCOPE, "pos", "turn_id", "session_id"), [SCOPE, "pos"])
    ids = F.array(F.struct(F.col("turn_id").alias("id"), F.lit(0).alias("b")), F.struct(F.col("session_id").alias("id"), F.lit(1).alias("b")))
    found = m.select("text_id", SCOPE, "pos", F.explode(ids).alias("x")).select("text_id", SCOPE, F.col("x.id").alias("source_id"),
                                                                                F.struct(F.lit(1).alias("k"), F.col("pos").cast("bigint").alias("a"), F.col("x.b").alias("b")).alias("o"))
    return said.unionByName(found).where(F.coalesce("source_id", F.lit("")) != "").groupBy("text_id", SCOPE, "source_id").agg(F.min("o").alias("o"))


def overlap_sources(texts: DataFrame, turns: DataFrame, ratio: float = 0.15, k: int = 5) -> DataFrame:
    """Turns sharing more than 15 % of a text's words, the best five (turn order breaks ties)."""
    words = lambda c: F.array_distinct(tx.find_all(F.lower(tx.text_of(c)), r"\S+"))
    p = overlap_pairs(texts.select(SCOPE, "text_id", words("text").alias("lw")), turns.select(SCOPE, "pos", words("text").alias("rw")), [SCOPE], "text_id", "pos", ratio, strict=True)
    best = top_k(p.withColumn("ratio", F.round("ratio", 9)), ["text_id"], [F.desc("ratio"), F.asc("pos")], k)
    return best.join(turns.select(SCOPE, "pos", "turn_id"), [SCOPE, "pos"]).select("text_id", SCOPE, F.col("turn_id").alias("source_id"), F.col("rank").cast("bigint").alias("rank"), F.round("ratio", 6).alias("ratio"))


def batch_sources(entries: DataFrame, turns: DataFrame, k: int = 5, floor: float = 0.34, slack: float = 0.08) -> DataFrame:
    """Of an entry's batch turns, those whose words it and its query share: 0.8·recall + 0.2·precision, +0.2 on a shared date.

    entries: text_id, scope, query, text, batch_ids
    """
    split = lambda c: F.array_distinct(F.filter(F.split(tx.normalize_for_source_match(c), " "), lambda x: x != ""))
    said = F.concat_ws(" ", tx.text_of("query"), tx.text_of("text"))
    # words and dates are worked out once per entry and once per turn, before the rows multiply
    e = entries.select("text_id", SCOPE, split(said).alias("m"), tx.extract_dates(said).alias("md"), F.array_distinct("batch_ids").alias("ids")).select(
        "text_id", SCOPE, "m", "md", F.posexplode("ids").alias("o", "turn_id"))
    u = turns.select(SCOPE, "turn_id", split("text").alias("a"), tx.extract_dates("timestamp").alias("ad"))
    j = e.join(u, [SCOPE, "turn_id"])
    inter = F.size(F.array_intersect("a", "m"))
    dates = F.coalesce(F.arrays_overlap("ad", "md"), F.lit(False))
    score = F.least(F.lit(1.0), 0.8 * inter / F.nullif(F.size("a"), F.lit(0)) + 0.2 * inter / F.nullif(F.size("m"), F.lit(0)) + F.when(dates, 0.2).otherwise(0.0))
    s = j.withColumn("score", F.round(F.when((F.size("a") == 0) | (F.size("m") == 0), 0.0).otherwise(score), 9)).where(F.col("score") >= floor)
    best = s.withColumn("_top", F.max("score").over(W.partitionBy("text_id"))).where(F.col("score") >= F.round(F.col("_top") - slack, 9))
    return top_k(best, ["text_id"], [F.desc("score"), F.asc("o")], k).select("text_id", SCOPE, F.col("turn_id").alias("source_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def usable_ids(entries: DataFrame, turns: DataFrame) -> DataFrame:
    """Entries' source ids, dropped where the list names more than max(20, history / 4) turns."""
    n = turns.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("_n"))
    ids = F.filter(F.transform("source_ids", tx.normalize_text), lambda x: x != "")
    j = entries.withColumn("_ids", ids).join(n, SCOPE, "left")
    broad = F.size(F.array_distinct("_ids")) > F.greatest(F.lit(20), F.floor(F.coalesce("_n", F.lit(0)) / 4))
    return j.withColumn("source_ids", F.when(broad, F.array().cast("array<string>")).otherwise(F.col("_ids"))).drop("_ids", "_n")


def entry_source_ids(entries: DataFrame) -> DataFrame:
    """Ids of an entry: its first non-empty id field, else ids written in its text, else its key.

    entries: entry_id, content, value_ids, metadata_ids
    """
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), tx.strip), lambda x: x != ""))
    written = clean(F.flatten(F.transform(tx.find_all(tx.text_of("content"), r"(?i)\bsource_ids?\s*[:=]\s*\[?([^\]\n;]+)", 1), lambda s: F.split(s, r"[\s,]+"))))
    picks = [F.when(F.size(clean(c)) > 0, clean(c)) for c in (F.col("value_ids"), F.col("metadata_ids"))]
    return entries.withColumn("source_ids", F.coalesce(*picks, F.when(F.size(written) > 0, written), F.array("entry_id")))


def trace_retrieval(retrieved: DataFrame, turns: DataFrame) -> DataFrame:
    """Ordered-unique source ids of each sample: per entry its usable ids, then inferred, then batch-inferred.

    retrieved: sample_id, scope, rank, entry_id, content, source_ids, query, batch_ids
    """
    r = cut_lineage(usable_ids(retrieved, turns).withColumn("text_id", F.concat_ws("#", "sample_id", "rank")))
    at = lambda phase, a: F.struct(F.col("rank").alias("r"), F.lit(phase).alias("p"), a.alias("a"))
    own = r.select("sample_id", "rank", F.posexplode("source_ids").alias("o", "source_id")).select(
        "sample_id", "source_id", at(0, F.struct(F.lit(0).alias("k"), F.col("o").cast("bigint").alias("a"), F.lit(0).alias("b"))).alias("place"))
    texts = r.select("text_id", SCOPE, F.col("content").alias("text"))
    key = r.select("text_id", "sample_id", "rank")
    said = infer_sources(texts, turns).join(key, "text_id").select("sample_id", "source_id", at(1, F.col("o")).alias("place"))
    picks = batch_sources(r.select("text_id", SCOPE, "query", F.col("content").alias("text"), "batch_ids"), turns).withColumnRenamed("rank", "o")
    inner = F.struct(F.lit(0).alias("k"), F.col("o").alias("a"), F.lit(0).alias("b"))
    batch = picks.join(key, "text_id").select("sample_id", "source_id", at(2, inner).alias("place"))
    once = own.unionByName(said).unionByName(batch).groupBy("sample_id", "source_id").agg(F.min("place").alias("place"))
    return top_k(once, ["sample_id"], [F.asc("place"), F.asc("source_id")], None).select("sample_id", "source_id", F.col("rank").cast("bigint").alias("rank"))


def id_set(ids: Column | str) -> Column:
    """Comparable ids: turn ids found inside an item, else the item itself, lower-cased."""
    c = F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<string>"))

    def parts(x):
        found = tx.find_all(tx.text_of(x), r"(?i)\bD\d+:\d+\b")
        return F.when(F.size(found) > 0, found).otherwise(F.array(tx.text_of(x)))

    flat = F.flatten(F.transform(c, parts))
    return F.array_distinct(F.filter(F.transform(flat, lambda x: F.lower(tx.normalize_text(x))), lambda x: x != ""))


def trace_gold(trace: DataFrame) -> DataFrame:
    """Gold found and missing at retrieval and prompt; the two baselines have rules of their own.

    trace: sample_id, system, gold_ids, retrieved_ids, injected_ids, known_ids (ids present in the history)
    """
    none = F.array().cast("array<string>")
    present = F.filter("gold_ids", lambda g: F.array_contains("known_ids", tx.normalize_text(g)))
    pick = lambda c: F.when(F.col("system") == "no_memory", none).when(F.col("system") == "full_context", present).otherwise(F.col(c))
    t = trace.withColumn("retrieved_ids", pick("retrieved_ids")).withColumn("injected_ids", pick("injected_ids"))
    g, r, i = id_set("gold_ids"), id_set("retrieved_ids"), id_set("injected_ids")
    mapped = F.when(F.col("system") == "no_memory", False).when(F.col("system") == "full_context", (F.size("retrieved_ids") > 0) | (F.size("gold_ids") == 0)).otherwise(
        (F.size("retrieved_ids") > 0) | (F.size("injected_ids") > 0))
    policy = F.when(F.col("system") == "no_memory", "zero_recall_baseline").when(F.col("system") == "full_context", "gold_coverage_without_listing_all_context").otherwise(
        "retrieval_and_prompt_source_ids")
    both = lambda a, b: F.array_sort(F.array_intersect(a, b))
    less = lambda a, b: F.array_sort(F.array_except(a, b))
    return t.select("sample_id", "system", both(g, r).alias("retrieved_gold_ids"), both(g, i).alias("prompt_gold_ids"), less(g, r).alias("missing_retrieved_gold_ids"),
                    less(g, i).alias("missing_prompt_gold_ids"), mapped.alias("source_mapping_available"), policy.alias("metric_policy"))


# -- expansion -------------------------------------------------------------

def expand_sources(retrieved: DataFrame, turns: DataFrame, limit: int = 8) -> DataFrame:
    """The retrieved entries followed by the turns they cite, each once, at most `limit`."""
    c = retrieved.select("sample_id", SCOPE, "rank", F.posexplode("source_ids").alias("o", "turn_id"))
    first = c.groupBy("sample_id", SCOPE, "turn_id").agg(F.min(F.struct("rank", "o")).alias("p")).join(turns.select(SCOPE, "turn_id", "text"), [SCOPE, "turn_id"])
    extra = top_k(first, ["sample_id"], [F.asc("p")], limit, "rn")
    n = retrieved.groupBy("sample_id").agg(F.max("rank").alias("_n"))
    more = extra.join(n, "sample_id").select("sample_id", (F.col("_n") + F.col("rn")).cast("bigint").alias("rank"), F.concat(F.lit("source:"), "turn_id").alias("entry_id"))
    return retrieved.select("sample_id", F.col("rank").cast("bigint").alias("rank"), "entry_id").unionByName(more)


def raw_fallback(retrieved: DataFrame, lane: DataFrame, k: int = 3) -> DataFrame:
    """The retrieved entries followed by the best lexical turns not cited yet.

    lane: sample_id, turn_id, rank
    """
    cited = retrieved.select("sample_id", F.explode("source_ids").alias("turn_id")).distinct()
    extra = top_k(lane.join(cited, ["sample_id", "turn_id"], "left_anti"), ["sample_id"], [F.asc("rank")], k, "rn")
    n = retrieved.groupBy("sample_id").agg(F.max("rank").alias("_n"))
    more = extra.join(n, "sample_id", "left").select("sample_id", (F.coalesce("_n", F.lit(0)) + F.col("rn")).cast("bigint").alias("rank"), F.concat(F.lit("raw:"), "turn_id").alias("entry_id"))
    return retrieved.select("sample_id", F.col("rank").cast("bigint").alias("rank"), "entry_id").unionByName(more)


def trace_prompt(prompts: DataFrame, entries: DataFrame, retrieved: DataFrame, turns: DataFrame, contexts: DataFrame) -> DataFrame:
    """Ordered-unique source ids of what was injected.

    Per entry: stored and retrieved ids (or the entry's own id), then per content the inferred and the batch-inferred ones;
    last what the whole memory block says, as a turn's words may be spread over several entries.

    prompts: sample_id, scope, place, entry_id; entries: entry_id, content, source_ids; retrieved: sample_id, entry_id,
    content, source_ids, query, batch_ids; contexts: sample_id, scope, text.
    """
    e = entries.select("entry_id", F.col("content").alias("ec"), F.col("source_ids").alias("es"))
    r = retrieved.select("sample_id", "entry_id", F.col("content").alias("rc"), F.col("source_ids").alias("rs"), "query", "batch_ids")
    j = prompts.join(e, "entry_id", "left").join(r, ["sample_id", "entry_id"], "left")
    none = F.array().cast("array<string>")
    u = usable_ids(j.withColumn("source_ids", F.coalesce("es", none)), turns).withColumn("es", F.col("source_ids"))
    u = usable_ids(u.withColumn("source_ids", F.coalesce("rs", none)), turns).withColumn("rs", F.col("source_ids"))
    u = cut_lineage(u)
    ids = F.concat("es", "rs")

    def at(place, phase, inner):
        return F.struct(place.cast("bigint").alias("r"), phase.cast("int").alias("p"), inner.alias("a")).alias("at")

    def plain(o):
        return F.struct(F.lit(0).alias("k"), o.cast("bigint").alias("a"), F.lit(0).alias("b"))

    cited = u.select("sample_id", "place", F.posexplode(F.when(F.size(ids) > 0, ids).otherwise(F.array("entry_id"))).alias("o", "source_id")).select(
        "sample_id", "source_id", at(F.col("place"), F.lit(0), plain(F.col("o"))))
    body = F.array_distinct(F.array_compact(F.array("ec", "rc")))
    texts = u.select("sample_id", SCOPE, "place", "query", "batch_ids", F.posexplode(body).alias("w", "text")).withColumn("text_id", F.concat_ws("#", "sample_id", "place", "w"))
    # the contents and the whole blocks are matched in one go; what comes of it is written, so no plan holds more than one matching
    blocks = contexts.select(F.concat(F.lit("block#"), "sample_id").alias("text_id"), SCOPE, "text", "sample_id", F.lit(2 ** 62).alias("place"), F.lit(0).alias("phase"))
    every = cut_lineage(texts.select("text_id", SCOPE, "text", "sample_id", F.col("place").cast("bigint").alias("place"), (1 + 2 * F.col("w")).alias("phase")).unionByName(blocks))
    said = cut_lineage(infer_sources(every.select("text_id", SCOPE, "text"), turns)).join(every.select("text_id", "sample_id", "place", "phase"), "text_id").select(
        "sample_id", "source_id", at(F.col("place"), F.col("phase"), F.col("o")))
    key = texts.select("text_id", "sample_id", "place", "w")
    picks = cut_lineage(batch_sources(texts.where(F.col("batch_ids").isNotNull()).select("text_id", SCOPE, "query", "text", "batch_ids"), turns))
    batch = picks.join(key, "text_id").select("sample_id", "source_id", at(F.col("place"), 2 + 2 * F.col("w"), plain(F.col("rank"))))
    once = cited.unionByName(said).unionByName(batch).groupBy("sample_id", "source_id").agg(F.min("at").alias("at"))
    return top_k(once, ["sample_id"], [F.asc("at"), F.asc("source_id")], None).select("sample_id", "source_id", F.col("rank").cast("bigint").alias("rank"))


def with_full_context(rows: DataFrame, keys: Sequence[str] = ("dataset", "task_type", "question_type", "sample_id"), value: str = "Acc") -> DataFrame:
    """Each system row beside the full-context row of its sample."""
    ref = rows.where("system = 'full_context'").groupBy(*keys).agg(F.max(value).alias(f"full_{value}"))
    return rows.join(ref, list(keys), "left")


def check_candidates(cands: DataFrame, queries: DataFrame, raws: DataFrame, size: int | None = None) -> DataFrame:
    """Per sample: candidates outside its conversation, repeats, and whether the size is as expected."""
    j = cands.join(queries.select("sample_id", F.col(SCOPE).alias("_q")), "sample_id").join(raws.select("raw_id", F.col(SCOPE).alias("_r")), "raw_id", "left")
    out = j.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_q").eqNullSafe(F.col("_r"))).alias("foreign"),
                                     (F.count(F.lit(1)) - F.countDistinct("raw_id")).alias("repeats"))
    return out.withColumn("ok", (F.col("foreign") == 0) & (F.col("repeats") == 0) & (F.lit(True) if size is None else F.col("n") == size))


# -- scoped pairs with a scorer of one's own -------------------------------

def scoped_cross(queries: DataFrame, docs: DataFrame, scorer, depth: int, rounded: int = 6) -> DataFrame:
    """(sample_id, raw_id, rank, score, n_candidates): the `depth` best records of each query's scope under any scorer.

    queries: sample_id, scope, …; docs: scope, raw_id, … with one row a record. scorer(q, d) takes the rows of a query block
    and of a record block as pandas frames and returns a matrix of scores. Blocks have a bounded size and give at most
    `depth` rows a query, so pairs are scored and never listed. Ties go by raw_id.
    """
    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = {"sample_id": [], "raw_id": [], "score": [], "n": []}
        if len(q) and len(d):
            d = d.iloc[np.argsort(d["raw_id"].to_numpy(dtype=object).astype(str), kind="stable")]
            s = np.asarray(scorer(q, d), dtype=np.float64)
            if s.shape != (len(q), len(d)):
                raise ValueError(f"scorer gave {s.shape} for {len(q)} queries and {len(d)} records")
            s = np.round(s, rounded) + 0.0
            top = np.argsort(-s, axis=1, kind="stable")[:, :depth]
            row = np.repeat(np.arange(len(q)), top.shape[1])
            first = np.zeros(top.shape, np.int64)
            first[:, 0] = len(d)
            out = {"sample_id": q["sample_id"].to_numpy(dtype=object)[row], "raw_id": d["raw_id"].to_numpy(dtype=object)[top.ravel()], "score": s[row, top.ravel()], "n": first.ravel()}
        return pd.DataFrame({k: pd.Series(v, dtype={"score": "float64", "n": "int64"}.get(k, object)) for k, v in out.items()})

    best = block_pairs(queries, docs).applyInPandas(run, "sample_id string, raw_id string, score double, n bigint")
    # A block says how many records it scored on the first row of each query.
    every = W.partitionBy("sample_id")
    counted = best.withColumn("n_candidates", F.sum("n").over(every)).drop("n")
    return top_k(counted, ["sample_id"], [F.desc("score"), F.asc("raw_id")], depth).select("sample_id", "raw_id", F.col("rank").cast("bigint").alias("rank"), "score", "n_candidates")


def word_share(words: str, of: str):
    """Scorer: share of a query's distinct words (column `of`) that a record holds (column `words`); both are lists."""
    def score(q: pd.DataFrame, d: pd.DataFrame) -> np.ndarray:
        held: dict[str, list[int]] = {}
        for at, ws in enumerate(d[words]):
            for w in set(ws):
                held.setdefault(w, []).append(at)
        s = np.zeros((len(q), len(d)))
        for i, ws in enumerate(q[of]):
            own = set(ws)
            for w in own:
                s[i, held.get(w, [])] += 1
            s[i] /= max(len(own), 1)
        return s
    return score
