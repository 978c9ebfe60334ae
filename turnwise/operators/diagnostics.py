"""Five-stage diagnosis: encoding, organization, retrieval, injection, utilization.

Evidence units are matched to entries, retrieved lists and prompts: containment, or 80 % of the
unit's words, pair by pair in bounded scopes and through the exact matching joins in larger ones.
The fuzzy clause (ratio ≥ 0.92) looks only at pairs nothing cheaper has decided whose lengths
could reach it. Model verdicts enter as tables.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.python_udfs import fuzzy_ratio, fuzzy_reaches
from ..session import cut_lineage
from . import joins as jn, lanes as ln
from .matching import contains_pairs, overlap_pairs
from .metrics import mean_null, ratio0
from .scale import top_k

#: Least ratio of a unit and a text that are close.
FUZZY = 0.92
#: Records of a scope beyond which its rankings are matched one by one, if they name less than half of the scope.
WIDE = 256
#: Pairs of a task that compares them one by one, most tasks.
TASK_PAIRS, MOST_TASKS = 1 << 20, 10_000
PROBE = {"k1": 1.5, "b": 0.75, "lexical": 0.5, "semantic": 0.5, "precision": 4}


def _words(c) -> Column:
    return F.filter(F.split(tx.normalize_answer(c), " "), lambda x: x != "")


def evidence_pairs(units: DataFrame, texts: DataFrame, keys: Sequence[str] = ("sample_id",), ratio: float = 0.8, fuzzy: float | None = FUZZY) -> DataFrame:
    """(unit, text) pairs where the text holds the unit, or 80 % of its words, or is close to it (`fuzzy_ratio` of `fuzzy` or more; None: left out).

    units: keys, unit_id, unit; texts: keys, text_id, text. Units and texts of a bounded scope meet once and nothing but the
    pairs found leaves that join; the words of larger scopes are spread out and joined on, texts of like length compared.
    """
    # read several times below: normalised once and written
    u = cut_lineage(units.select(*keys, "unit_id", tx.normalize_answer("unit").alias("nt")).where("nt <> ''"))
    t = cut_lineage(texts.select(*keys, "text_id", tx.normalize_answer("text").alias("ht")).where("ht <> ''"))
    few, many, tasks = _by_size(u, t, keys)
    found = _pairs_met(*few, keys, ratio, fuzzy, tasks)
    if many is not None:
        u, t = many
        held = cut_lineage(contains_pairs(u, t, keys, "unit_id", "text_id").select(*keys, "unit_id", "text_id"))
        cover = overlap_pairs(u.select(*keys, "unit_id", F.split("nt", " ").alias("lw")), t.select(*keys, "text_id", F.split("ht", " ").alias("rw")),
                              keys, "unit_id", "text_id", ratio).select(*keys, "unit_id", "text_id")
        found = found.unionByName(held).unionByName(cover)
        if fuzzy is not None:
            found = found.unionByName(_close_pairs(u, t, keys, fuzzy))
    return found.distinct()


def _by_size(u: DataFrame, t: DataFrame, keys: Sequence[str]):
    """Both sides of the scopes that are compared pair by pair, those of the larger ones (None where there are none), and tasks for the former."""
    size = lambda df, c: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    sizes = cut_lineage(size(u, "nu").join(size(t, "nt"), list(keys)))
    direct = (F.col("nt") * F.col("nu") <= jn.DIRECT_PAIRS) & (F.greatest("nt", "nu") <= jn.DIRECT_ROWS)
    pairs, large = sizes.agg(F.sum(F.when(direct, F.col("nt") * F.col("nu"))), F.count_if(~direct)).first()
    tasks = max(u.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, (pairs or 0) // TASK_PAIRS + 1))
    if not large:
        return (u, t), None, tasks
    part = lambda how: tuple(df.join(F.broadcast(sizes.where(~direct).select(*keys)), list(keys), how) for df in (u, t))
    return part("left_anti"), part("left_semi"), tasks


def _pairs_met(u: DataFrame, t: DataFrame, keys: Sequence[str], ratio: float, fuzzy: float | None, tasks: int) -> DataFrame:
    """`evidence_pairs` of all pairs of a scope. Normalised words stand between single blanks; pairs, not bytes, tell how many tasks there are."""
    u = u.select(*keys, "unit_id", "nt").withColumns(_asked_words(ratio))
    j = u.repartition(tasks, *keys).join(t.withColumn("_text", _between(F.col("ht"))).drop("ht").repartition(tasks, *keys), list(keys))
    known = _holds("_text")
    if fuzzy is None:
        return j.where(known).select(*keys, "unit_id", "text_id")
    j = j.withColumn("_known", known).where(F.col("_known") | _lengths_allow(fuzzy, F.length("_text") - 2))
    ask = lambda c: F.when(~F.col("_known"), c)
    return j.withColumn("_close", fuzzy_reaches(fuzzy)(ask(F.col("nt")), ask(_inside("_text")))).where("_known or _close").select(*keys, "unit_id", "text_id")


def _between(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def _inside(c: str) -> Column:
    return F.col(c).substr(F.lit(2), F.length(c) - 2)


def _asked_words(ratio: float) -> dict[str, Column]:
    """A unit's distinct words between blanks, and how many of them a text has to hold."""
    words = F.array_distinct(F.split("nt", " "))
    return {"_words": F.transform(words, _between), "_need": F.greatest(F.ceil(F.size(words) * ratio - 1e-9), F.lit(1)).cast("int")}


def _holds(text: str) -> Column:
    """Whether a normalised text (between blanks) holds the unit, or enough of its words."""
    return F.contains(text, F.col("nt")) | (F.size(F.filter("_words", lambda w: F.contains(text, w))) >= F.col("_need"))


def _lengths_allow(least: float, b: Column) -> Column:
    a = F.length("nt")
    return 2 * F.least(a, b) / (a + b) >= least


def _close_pairs(u: DataFrame, t: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Pairs of a ratio of `least` or more: lengths are dealt to steps so wide that those of a pair are neighbours."""
    step = lambda c: F.floor(F.log(F.length(c)) / math.log((2 - least) / least) + 1e-6).cast("int")
    near = t.withColumn("_step", F.explode(F.array(*[step("ht") + i for i in (-1, 0, 1)])))
    j = u.withColumn("_step", step("nt")).join(near, [*keys, "_step"]).where(_lengths_allow(least, F.length("ht")))
    return j.where(fuzzy_reaches(least)("nt", "ht")).select(*keys, "unit_id", "text_id")


def ranked_evidence_pairs(units: DataFrame, records: DataFrame, ranking: DataFrame, ratio: float = 0.8, fuzzy: float | None = FUZZY) -> DataFrame:
    """`evidence_pairs` of a sample's units and the records of its ranking.

    A record stands in as many rankings as its scope has questions, so it is matched once per scope and the pairs are then
    held against the ranking. Where rankings are short against a scope of many records, only their records are matched, sample by sample.
    units: sample_id, scope, unit_id, unit; records: scope, text_id, text; ranking: sample_id, text_id
    """
    samples = cut_lineage(units.groupBy(ln.SCOPE, "sample_id").agg(F.count(F.lit(1)).alias("n")))
    n = records.groupBy(ln.SCOPE).agg(F.count(F.lit(1)).alias("nt")).where(F.col("nt") > WIDE)
    rows = samples.join(n, ln.SCOPE).join(ranking.select("sample_id"), "sample_id", "left").groupBy(ln.SCOPE).agg(F.count(F.lit(1)).alias("nr"), F.max("nt").alias("nt"), F.countDistinct("sample_id").alias("ns"))
    wide = cut_lineage(rows.where(2 * F.col("nr") < F.col("nt") * F.col("ns")).select(ln.SCOPE))
    some = not wide.isEmpty()
    part = lambda df, how: df.join(F.broadcast(wide), ln.SCOPE, how) if some else df
    u = part(units, "left_anti").select(ln.SCOPE, F.struct("sample_id", "unit_id").alias("unit_id"), "unit")
    p = evidence_pairs(u, part(records, "left_anti"), (ln.SCOPE,), ratio, fuzzy).select(F.col("unit_id.sample_id").alias("sample_id"), F.col("unit_id.unit_id").alias("unit_id"), "text_id")
    p = p.join(ranking.select("sample_id", "text_id"), ["sample_id", "text_id"], "left_semi").select("sample_id", "unit_id", "text_id")
    if not some:
        return p
    own = ranking.select("sample_id", "text_id").join(part(samples, "left_semi").select("sample_id", ln.SCOPE), "sample_id")
    copies = own.join(part(records, "left_semi"), [ln.SCOPE, "text_id"]).select("sample_id", "text_id", "text")
    return p.unionByName(evidence_pairs(part(units, "left_semi").select("sample_id", "unit_id", "unit"), copies, ("sample_id",), ratio, fuzzy).select("sample_id", "unit_id", "text_id"))


def ranked_duplicates(records: DataFrame, ranking: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Number of `duplicate_pairs` inside each sample's ranking, found once per scope. ranking: sample_id, text_id; gives sample_id, dups"""
    near = duplicate_pairs(records.select(ln.SCOPE, "text_id", "text"), (ln.SCOPE,), ratio).select("text_id", "other_id")
    r = ranking.select("sample_id", "text_id")
    j = near.join(r, "text_id").join(r.withColumnRenamed("text_id", "other_id"), ["sample_id", "other_id"])
    return j.groupBy("sample_id").agg(F.count(F.lit(1)).alias("dups"))


def evidence_in_text(pairs: DataFrame, fuzzy: bool = True, verdicts: DataFrame | None = None) -> DataFrame:
    """Verdict for given (unit, text) pairs, cheap rules first; `matched` is null where all rules say no and no verdict exists.

    pairs: pair_id, unit, text; verdicts: pair_id, verdict
    """
    p = pairs.withColumn("_u", tx.normalize_answer("unit")).withColumn("_t", tx.normalize_answer("text"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    u, t = words("_u"), words("_t")
    empty = (F.col("_u") == "") | (F.col("_t") == "")
    p = p.withColumn("rule", F.when(empty, "empty").when(F.contains("_t", F.col("_u")), "contains").when(F.size(F.array_intersect(u, t)) / F.nullif(F.size(u), F.lit(0)) >= 0.8, "coverage"))
    if fuzzy:
        a, b = F.length("_u"), F.length("_t")
        # the ratio cannot exceed this; pairs that need no ratio go by as nulls, so the pairs are read once
        ask = F.col("rule").isNull() & (2 * F.least(a, b) / (a + b) >= 0.92)
        p = p.withColumn("_r", fuzzy_reaches(0.92)(F.when(ask, F.col("_u")), F.when(ask, F.col("_t")))).withColumn("rule", F.coalesce("rule", F.when(F.col("_r"), "fuzzy")))
    out = p.select("pair_id", "rule")
    if verdicts is not None:
        out = out.join(verdicts, "pair_id", "left").withColumn("rule", F.coalesce("rule", F.when(F.col("verdict"), "verdict"))).drop("verdict")
    return out.withColumn("matched", F.col("rule").isin("contains", "coverage", "fuzzy", "verdict"))


def fact_units(facts: DataFrame) -> DataFrame:
    """Four renderings of a fact. facts: sample_id, fact_id, subject, attribute, value"""
    s, a, v = (tx.text_of(c) for c in ("subject", "attribute", "value"))
    forms = F.array(v, F.concat_ws(" ", s, a, v), F.concat(s, F.lit("'s "), a, F.lit(" is "), v), F.concat(a, F.lit(": "), v))
    return facts.select("sample_id", "fact_id", F.posexplode(forms).alias("form", "unit")).where("unit <> ''").withColumn("unit_id", F.concat_ws("#", "fact_id", "form"))


def fact_in_entries(facts: DataFrame, entries: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Whether any rendering of a fact is in its entries; entries citing the fact's turns are tried alone.

    facts: …, source_turn_ids; entries: sample_id, text_id, text, source_ids
    With `matches` (sample_id, unit_id, text_id: the pairs of `fact_units` and entries) no text is read.
    """
    hit = (evidence_pairs(fact_units(facts), entries) if matches is None else matches).withColumn("fact_id", F.regexp_replace("unit_id", r"#\d+$", "")).select("sample_id", "fact_id", "text_id").distinct()
    cites = facts.select("sample_id", "fact_id", F.explode("source_turn_ids").alias("turn")).join(
        entries.select("sample_id", "text_id", F.explode("source_ids").alias("turn")), ["sample_id", "turn"]).select("sample_id", "fact_id", "text_id").distinct().withColumn("cited", F.lit(True))
    j = cites.join(hit.withColumn("hit", F.lit(True)), ["sample_id", "fact_id", "text_id"], "full_outer")
    per = j.groupBy("sample_id", "fact_id").agg(F.max("cited").alias("targeted"), F.max(F.col("cited") & F.col("hit")).alias("t_hit"), F.max("hit").alias("any_hit"))
    found = F.coalesce(F.when(F.col("targeted"), F.coalesce("t_hit", F.lit(False))), F.col("any_hit"), F.lit(False))
    return facts.select("sample_id", "fact_id").join(per, ["sample_id", "fact_id"], "left").select("sample_id", "fact_id", F.coalesce("targeted", F.lit(False)).alias("targeted"), found.alias("found"))


def answer_correct(rows: DataFrame, fuzzy: bool = True, verdicts: DataFrame | None = None) -> DataFrame:
    """Equal to, containing, or (ratio ≥ 0.9) close to an acceptable answer. rows: sample_id, pred_answer, golds"""
    pred = tx.normalize_answer("pred_answer")
    golds = F.filter(F.transform("golds", tx.normalize_answer), lambda g: g != "")
    r = rows.withColumn("_p", pred).withColumn("_g", golds).withColumn("rule", F.when(F.exists("_g", lambda g: g == F.col("_p")), "equal").when(
        F.exists("_g", lambda g: F.contains(F.col("_p"), g)), "contains"))
    if fuzzy:
        each = r.where("rule is null").select("sample_id", "_p", F.explode("_g").alias("g"))
        a, b = F.length("_p"), F.length("g")
        close = each.where(2 * F.least(a, b) / (a + b) >= 0.9).withColumn("_r", fuzzy_reaches(0.9)("g", "_p")).where("_r").select("sample_id").distinct().withColumn("_f", F.lit("fuzzy"))
        r = r.join(close, "sample_id", "left").withColumn("rule", F.coalesce("rule", "_f")).drop("_f")
    if verdicts is not None:
        r = r.join(verdicts, "sample_id", "left").withColumn("rule", F.coalesce("rule", F.when(F.col("verdict"), "verdict"))).drop("verdict")
    return r.withColumn("Acc", F.col("rule").isNotNull().cast("int")).drop("_p", "_g")


def text_similarity(pairs: DataFrame) -> DataFrame:
    """1 if equal, else embedding cosine where both vectors exist, else max(Jaccard, fuzzy ratio).

    pairs: pair_id, a, b, va, vb (nullable vectors)
    """
    p = pairs.withColumn("_a", tx.normalize_answer("a")).withColumn("_b", tx.normalize_answer("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)
    cos = F.try_divide(dot(F.col("va"), F.col("vb")), F.sqrt(dot(F.col("va"), F.col("va"))) * F.sqrt(dot(F.col("vb"), F.col("vb"))))
    a, b = F.array_distinct(_words("a")), F.array_distinct(_words("b"))
    jac = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    s = F.when((F.col("_a") == "") | (F.col("_b") == ""), 0.0).when(F.col("_a") == F.col("_b"), 1.0).when(
        cos.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    p = p.withColumn("similarity", s).withColumn("_j", jac)
    known = p.where("similarity is not null").select("pair_id", "similarity")
    # a ratio above the Jaccard value needs lengths that allow it
    open_ = p.where("similarity is null")
    la, lb = F.length("_a"), F.length("_b")
    can = 2 * F.least(la, lb) / (la + lb) > F.col("_j")
    rest = open_.where(can).select("pair_id", F.greatest("_j", fuzzy_ratio("_a", "_b")).alias("similarity"))
    return known.unionByName(rest).unionByName(open_.where(~can).select("pair_id", F.col("_j").alias("similarity")))


def contradiction_candidates(pairs: DataFrame, verdicts: DataFrame | None = None, low: float = 0.3, high: float = 0.85) -> DataFrame:
    """Pairs (answer, entry) alike but not the same, whose entry lacks the answer; a verdict table settles them."""
    band = text_similarity(pairs).where((F.col("similarity") > low) & (F.col("similarity") < high))
    lacks = pairs.where(~F.contains(tx.normalize_answer("b"), tx.normalize_answer("a"))).select("pair_id")
    c = band.join(lacks, "pair_id")
    return c if verdicts is None else c.join(verdicts.where("verdict"), "pair_id", "left_semi")


#: Counters (by hash) that tell rare words from common ones; they only order words, so that sharing one makes no difference to the result.
COUNTERS = 1 << 17


def _hashed_words(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, text_id, w: the distinct words of a text as sorted 64-bit hashes; texts without words are left out."""
    w = F.array_sort(F.transform(F.array_distinct(_words("text")), lambda x: F.xxhash64(x)))
    return entries.select(*keys, "text_id", w.alias("w")).where(F.size("w") > 0).dropna(subset=list(keys))


def _rarest(counts: np.ndarray, ratio: float):
    """The last column, a list of hashes, is cut to its rarest members: two sets that share `ratio` of either's share one of those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            size = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((flat, counts[flat & (COUNTERS - 1)], row))
            keep = size - np.maximum(np.ceil(size * ratio - 1e-9), 1).astype(np.int64) + 1
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)).astype(np.int32)), pa.array(flat[by][at < np.repeat(keep, size)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], batch.schema.names)
    return run


def near_classes(entries: DataFrame, keys: Sequence[str] = ("sample_id",), ratio: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries of equal word sets as classes, and the pairs of classes whose Jaccard is above `ratio`.

    Gives written rows (keys, text_id, f, g: two hashes of the set), classes (keys, f, g, text_id: the least of its members, n words, m members)
    and pairs (keys, text_id, other_id, m, other_m of two classes). Word sets of a qualifying pair share one of the rarest words of
    either; the places of the first that they share bound the overlap, and only sets of the pairs left are compared.
    """
    keys = list(keys)
    hashed = _hashed_words(entries, keys)
    counts = np.zeros(COUNTERS, np.int64)
    for r in hashed.select(F.explode("w").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count(F.lit(1)).alias("c")).toLocalIterator():
        counts[r["at"]] = r["c"]
    full = hashed.select(*keys, "text_id", F.size("w").alias("n"), F.xxhash64("w").alias("f"), F.xxhash64(F.lit(1), "w").alias("g"), "w")
    rows = cut_lineage(full.mapInArrow(_rarest(counts, ratio), full.schema))
    classes = cut_lineage(rows.groupBy(*keys, "f", "g").agg(F.min("text_id").alias("text_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), F.first("w").alias("w")))
    each = classes.select(*keys, "text_id", "n", "m", F.posexplode("w").alias("at", "w"))
    other = each.select(*keys, "w", *[F.col(c).alias(f"other_{c}") for c in ("text_id", "n", "m", "at")])
    need = F.ceil(ratio / (1 + ratio) * (F.col("n") + F.col("other_n")) - 1e-9)
    ordered = F.struct("n", "text_id") < F.struct("other_n", "other_text_id")
    met = each.join(other, [*keys, "w"]).where(ordered & (F.col("n") >= F.col("other_n") * ratio - 1e-9) & (F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at")) >= need))
    pairs = cut_lineage(met.select(*keys, "text_id", F.col("other_text_id").alias("other_id"), "m", "other_m").distinct())
    asked = pairs.select(*keys, "text_id").unionByName(pairs.select(*keys, F.col("other_id").alias("text_id"))).distinct()
    held = cut_lineage(hashed.join(asked, [*keys, "text_id"], "left_semi"))
    j = pairs.join(held, [*keys, "text_id"]).join(held.select(*keys, F.col("text_id").alias("other_id"), F.col("w").alias("v")), [*keys, "other_id"])
    both = F.size(F.array_intersect("w", "v"))
    near = j.where(both / (F.size("w") + F.size("v") - both) > ratio).select(*keys, "text_id", "other_id", "m", "other_m")
    return rows.drop("n", "w"), classes.drop("w"), near


def duplicate_pairs(entries: DataFrame, keys: Sequence[str] = ("sample_id",), ratio: float = 0.85) -> DataFrame:
    """Entry pairs of a sample whose word sets have Jaccard above `ratio`: those inside a class and across near ones."""
    keys = list(keys)
    rows, classes, near = near_classes(entries, keys, ratio)
    of = lambda c: classes.select(*keys, F.col("text_id").alias(c), F.col("f").alias(f"{c}_f"), F.col("g").alias(f"{c}_g"))
    links = near.select(*keys, F.col("text_id").alias("a"), F.col("other_id").alias("b")).join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"]).select(*keys, "a_f", "a_g", "b_f", "b_g")
    same = classes.where("m > 1").select(*keys, *[F.col(c).alias(f"{s}_{c}") for s in "ab" for c in "fg"])
    member = lambda s, c: rows.select(*keys, F.col("text_id").alias(c), F.col("f").alias(f"{s}_f"), F.col("g").alias(f"{s}_g"))
    met = lambda df: df.join(member("a", "x"), [*keys, "a_f", "a_g"]).join(member("b", "y"), [*keys, "b_f", "b_g"])
    every = met(same).where("x < y").unionByName(met(links))
    return every.select(*keys, F.least("x", "y").alias("text_id"), F.greatest("x", "y").alias("other_id"))


def duplicate_counts(entries: DataFrame, keys: Sequence[str] = ("sample_id",), ratio: float = 0.85) -> DataFrame:
    """Number of `duplicate_pairs` of each sample that has one, as keys, dups; copies are counted, not paired."""
    _, classes, near = near_classes(entries, keys, ratio)
    inside = classes.where("m > 1").select(*keys, (F.col("m") * (F.col("m") - 1) / 2).cast("bigint").alias("c"))
    return inside.unionByName(near.select(*keys, (F.col("m") * F.col("other_m")).alias("c"))).groupBy(*keys).agg(F.sum("c").alias("dups"))


def encoding_metrics(units: DataFrame, entries: DataFrame, contradictions: DataFrame | None = None, matches: DataFrame | None = None, dups: DataFrame | None = None) -> DataFrame:
    """Q_FCR (units covered), RDR (duplicate pairs), CMR (entries matched) and CMR_M per sample.

    With `matches` (as `evidence_pairs`) and `dups` (sample_id, dups) no text is read.
    """
    m = cut_lineage(evidence_pairs(units, entries)) if matches is None else matches
    cov = m.groupBy("sample_id").agg(F.countDistinct("unit_id").alias("covered"), F.countDistinct("text_id").alias("used"))
    nu = units.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_units"))
    ne = entries.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_entries"))
    dup = duplicate_counts(entries) if dups is None else dups
    j = ne.join(nu, "sample_id", "full_outer").join(cov, "sample_id", "left").join(dup, "sample_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    pairs = z("n_entries") * (z("n_entries") - 1) / 2
    out = j.select("sample_id", F.try_divide(z("covered"), F.col("n_units")).alias("Q_FCR"), ratio0(z("dups"), pairs).alias("RDR"), F.try_divide(z("used"), F.col("n_entries")).alias("CMR"))
    if contradictions is None:
        return out.withColumn("CMR_M", F.lit(0))
    c = contradictions.select("sample_id").distinct().withColumn("_c", F.lit(1))
    return out.join(c, "sample_id", "left").withColumn("CMR_M", F.coalesce("_c", F.lit(0))).drop("_c")


def minmax(scores: DataFrame, keys: Sequence[str] = ("sample_id",), value: str = "score") -> DataFrame:
    """Scores of a key scaled to [0, 1]; a flat key reads 0. The extremes come from an aggregation, not a window."""
    ext = scores.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = scores.join(ext, list(keys))
    span = F.col("_hi") - F.col("_lo")
    return j.withColumn(value, F.when(span <= 1e-8, 0.0).otherwise((F.col(value) - F.col("_lo")) / span)).drop("_lo", "_hi")


def visibility(weights: DataFrame, levels: DataFrame) -> DataFrame:
    """Scaled larger of weight and priority, raised to the level priority 1 − rank / max rank.

    weights: sample_id, entry_id, value (weights and priorities as rows); levels: sample_id, entry_id, level_rank
    """
    w = minmax(weights.groupBy("sample_id", "entry_id").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("score"))).select("sample_id", "entry_id", "score")
    l = levels.groupBy("sample_id", "entry_id").agg(F.max("level_rank").alias("r"))
    top = l.groupBy("sample_id").agg(F.max("r").alias("m"))
    p = l.join(top, "sample_id").select("sample_id", "entry_id", F.when(F.col("m") == 0, 1.0).otherwise(1.0 - F.col("r") / F.col("m")).alias("score"))
    return w.unionByName(p).groupBy("sample_id", "entry_id").agg(F.max("score").alias("visibility"))


def standard_probe(queries: DataFrame, entries: DataFrame, similarity: DataFrame, priority: DataFrame | None, k: int = 5) -> DataFrame:
    """Top k by 0.5·BM25 + 0.5·similarity (both scaled), bucketed to 4 places; structure only breaks ties; ids descend.

    queries: sample_id, scope, query_text; entries: scope, raw_id, text; similarity: sample_id, raw_id, score over every
    entry of the sample's own memory — that table carries the pairs, so none are built here.
    """
    lex = ln.bm25_scores(queries, entries, PROBE["k1"], PROBE["b"], "space", 1e-6).select("sample_id", "raw_id", F.col("score").alias("lex"))
    both = similarity.select("sample_id", "raw_id", "score").join(lex, ["sample_id", "raw_id"], "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    return probe_ranks(probe_scores(both), priority, k)


def probe_scores(both: DataFrame) -> DataFrame:
    """sample_id, raw_id, combined, bucket. both: sample_id, raw_id, score (similarity), lex (BM25)"""
    s = minmax(minmax(both), value="lex")
    s = s.withColumn("combined", F.round(PROBE["lexical"] * F.col("lex") + PROBE["semantic"] * F.col("score"), 9))
    return s.select("sample_id", "raw_id", "combined", F.round("combined", PROBE["precision"]).alias("bucket"))


def probe_ranks(scores: DataFrame, priority: DataFrame | None, k: int = 5) -> DataFrame:
    """The k best of `probe_scores`; priority (sample_id, entry_id, visibility) breaks ties of a bucket."""
    s = scores
    if priority is not None:
        s = s.join(priority.select("sample_id", F.col("entry_id").alias("raw_id"), "visibility"), ["sample_id", "raw_id"], "left")
    vis = F.coalesce("visibility", F.lit(0.0)) if priority is not None else F.lit(0.0)
    s = s.withColumn("priority", vis)
    return top_k(s, ["sample_id"], [F.desc("bucket"), F.desc("priority"), F.desc("combined"), F.desc("raw_id")], k).select(
        "sample_id", "raw_id", F.col("rank").cast("bigint").alias("rank"), "bucket")


def member_scores(queries: DataFrame, records: DataFrame, members: DataFrame, similarity: Column, profile: str = "space", floor: float = 1e-6) -> DataFrame:
    """Similarity (score) and BM25 (lex) of the records that a sample's memory names; frequencies and lengths are those of its members.

    queries: sample_id, query_text; records: raw_id, text; members: sample_id, raw_id; similarity: over query_text and text. A member meets its
    query and its text once, and keeps only the counts of the asked terms; all that follows is dealt by sample once.
    """
    k1, b = PROBE["k1"], PROBE["b"]
    j = members.select("sample_id", "raw_id").join(queries.select("sample_id", "query_text"), "sample_id").join(records.select("raw_id", "text"), "raw_id")
    j = j.select("sample_id", "raw_id", similarity.alias("score"), tx.tokens("query_text", profile).alias("_q"), tx.tokens("text", profile).alias("_t"))
    j = j.withColumn("_h", F.filter("_t", lambda x: F.array_contains("_q", x)))
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    hits = F.transform(F.array_distinct("_h"), lambda x: F.struct(x.alias("term"), count("_h", x).alias("tf"), count("_q", x).alias("qtf")))
    own = cut_lineage(j.select("sample_id", "raw_id", "score", F.size("_t").alias("dl"), hits.alias("hits"))).repartition("sample_id")
    stats = own.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(floor)).alias("avg"))
    df = own.select("sample_id", F.explode("hits.term").alias("term")).groupBy("sample_id", "term").agg(F.count(F.lit(1)).alias("df"))
    dfs = df.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("_df"))
    r = own.join(stats, "sample_id").join(dfs, "sample_id", "left")

    def part(h):
        held = F.col("_df")[h["term"]]
        idf = F.log(1 + (F.col("n") - held + 0.5) / (held + 0.5))
        return h["qtf"] * idf * h["tf"] * (k1 + 1) / (h["tf"] + k1 * (1 - b + b * F.col("dl") / F.col("avg")))

    return r.select("sample_id", "raw_id", "score", F.round(F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + part(h)), ln.ROUND).alias("lex"))


def unit_recall(units: DataFrame, ranked: DataFrame, matches: DataFrame) -> DataFrame:
    """Share of a sample's units matched within a ranking, and the first rank of any of them.

    ranked: sample_id, raw_id, rank; matches: sample_id, unit_id, text_id
    """
    n = units.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    first = matches.withColumnRenamed("text_id", "raw_id").join(ranked, ["sample_id", "raw_id"]).groupBy("sample_id", "unit_id").agg(F.min("rank").alias("r"))
    per = first.groupBy("sample_id").agg(F.count(F.lit(1)).alias("c"), F.min("r").alias("first_rank"))
    return n.join(per, "sample_id", "left").select("sample_id", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("recall"), "first_rank")


def organization_metrics(units: DataFrame, with_structure: DataFrame, flat: DataFrame, matches: DataFrame, contradictions: DataFrame, vis: DataFrame) -> DataFrame:
    """Recall of the structured and flat probe, their difference, and whether correct entries outshine contradicting ones."""
    a = unit_recall(units, with_structure, matches).select("sample_id", F.col("recall").alias("RFR_std_sigma"))
    b = unit_recall(units, flat, matches).select("sample_id", F.col("recall").alias("RFR_std_flat"))
    see = lambda df: df.select("sample_id", F.col("text_id").alias("entry_id")).distinct().join(vis, ["sample_id", "entry_id"], "left").groupBy("sample_id").agg(
        F.max(F.coalesce("visibility", F.lit(0.0))).alias("v"))
    good, bad = see(matches).withColumnRenamed("v", "g"), see(contradictions).withColumnRenamed("v", "c")
    j = a.join(b, "sample_id").join(good, "sample_id", "left").join(bad, "sample_id", "left")
    return j.select("sample_id", "RFR_std_sigma", "RFR_std_flat", (F.col("RFR_std_sigma") - F.col("RFR_std_flat")).alias("OQG"),
                    F.when(F.col("g").isNotNull() & F.col("c").isNotNull(), (F.col("g") > F.col("c")).cast("int")).alias("CP_ratio"))


def retrieval_metrics(units: DataFrame, retrieved: DataFrame, matches: DataFrame, standard: DataFrame, k: int = 5, contradictions: DataFrame | None = None) -> DataFrame:
    """RFR@k, its gain over the standard probe, MRR and CMR_R. standard: sample_id, RFR_std_sigma"""
    u = unit_recall(units, retrieved.where(F.col("rank") <= k), matches).join(standard, "sample_id", "left")
    out = u.select("sample_id", F.col("recall").alias("RFR"), (F.col("recall") - F.col("RFR_std_sigma")).alias("RAG"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("MRR"))
    if contradictions is None:
        return out.withColumn("CMR_R", F.lit(0))
    c = contradictions.withColumnRenamed("text_id", "raw_id").join(retrieved.where(F.col("rank") <= k), ["sample_id", "raw_id"]).select("sample_id").distinct().withColumn("_c", F.lit(1))
    return out.join(c, "sample_id", "left").withColumn("CMR_R", F.coalesce("_c", F.lit(0))).drop("_c")


def injection_metrics(units: DataFrame, prompts: DataFrame, retrieval: DataFrame | None = None, contradictions: DataFrame | None = None, fuzzy: float | None = FUZZY) -> tuple[DataFrame, DataFrame]:
    """Where each unit stands in its prompt; PCR, TL, PS and CMR_P per sample.

    units: sample_id, unit_id, unit; prompts: sample_id, system_prompt, user_prompt, memory_context, full_prompt and maybe
    contradicts (a verdict on the prompt); contradictions: the sample_id of prompts that a verdict says contradict the answer.
    A prompt meets the list of its units in one row: its texts are shuffled as they are, and normalised once.
    """
    parts = ["system_prompt", "user_prompt", "memory_context", "full_prompt"]
    flag = F.coalesce("contradicts", F.lit(False)) if "contradicts" in prompts.columns else F.lit(False)
    asked = units.groupBy("sample_id").agg(F.collect_list(F.struct("unit_id", "unit", tx.normalize_answer("unit").alias("nt"))).alias("_units"))
    met = prompts.select("sample_id", *parts, flag.alias("_flag")).join(asked, "sample_id")
    met = met.select("sample_id", "full_prompt", "_flag", *[_between(tx.normalize_answer(c)).alias(f"_{i}") for i, c in enumerate(parts)], F.explode("_units").alias("_u"))
    j = met.select("sample_id", "_u.unit_id", "_u.unit", "_u.nt", "full_prompt", "_flag", *[f"_{i}" for i in range(len(parts))]).withColumns(_asked_words(0.8))
    holds = [(F.col("nt") != "") & (F.length(f"_{i}") > 2) & _holds(f"_{i}") for i in range(len(parts))]
    j = j.withColumn("_part", F.coalesce(*[F.when(h, i) for i, h in enumerate(holds)]))
    if fuzzy is not None:
        ask = lambda i: (F.col("nt") != "") & (i < F.coalesce("_part", F.lit(len(parts)))) & _lengths_allow(fuzzy, F.length(f"_{i}") - 2)
        close = [fuzzy_reaches(fuzzy)(F.when(ask(i), F.col("nt")), F.when(ask(i), _inside(f"_{i}"))) for i in range(len(parts))]
        j = j.withColumns({f"_c{i}": c for i, c in enumerate(close)}).withColumn("_part", F.coalesce(*[F.when(F.col(f"_c{i}"), i) for i in range(len(parts))], "_part"))
    low = F.lower(tx.strip(F.col("unit")))
    at = F.when(low != "", F.instr(F.lower(F.col("full_prompt")), low) - 1)
    names = F.array(*map(F.lit, ["system_prompt", "front_user_prompt", "middle_context", "end_context"]))
    place = F.when((at >= 0) & (F.length("full_prompt") > 0), 1.0 - at / F.length("full_prompt"))
    j = cut_lineage(j.select("sample_id", "unit_id", F.coalesce(F.try_element_at(names, F.col("_part") + 1), F.lit("not_injected")).alias("bucket"), place.alias("place"), "_flag"))
    per = j.groupBy("sample_id").agg((F.count_if(F.col("bucket") != "not_injected") / F.count(F.lit(1))).alias("PCR"), F.avg("place").alias("PS"), F.max(F.col("_flag").cast("int")).alias("CMR_P"))
    if contradictions is not None:
        c = contradictions.select("sample_id").distinct().withColumn("_c", F.lit(1))
        per = per.join(c, "sample_id", "left").withColumn("CMR_P", F.greatest(F.coalesce("_c", F.lit(0)), "CMR_P")).drop("_c")
    out = per if retrieval is None else per.join(retrieval.select("sample_id", "RFR"), "sample_id", "left").withColumn("TL", F.col("RFR") - F.col("PCR")).drop("RFR")
    return j.select("sample_id", "unit_id", "bucket", "place"), out


def counterfactual_variants(samples: DataFrame) -> DataFrame:
    """Variants of the samples that carry a counterfactual; its fields replace the originals.

    samples: sample_id, question, answer, question_type, task_type, cf struct<question,answer,expected_answer,question_type>
    """
    c = samples.where("cf is not null")
    return c.select(F.concat("sample_id", F.lit("__counterfactual")).alias("sample_id"), F.col("sample_id").alias("counterfactual_of"),
                    F.coalesce(F.nullif("cf.question", F.lit("")), F.col("question")).alias("question"),
                    F.coalesce(F.nullif("cf.answer", F.lit("")), F.nullif("cf.expected_answer", F.lit("")), F.col("answer")).alias("answer"),
                    F.coalesce(F.nullif("cf.question_type", F.lit("")), F.nullif("question_type", F.lit("")), F.col("task_type")).alias("question_type"))


def counterfactual(original: DataFrame, changed: DataFrame, expected: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Did the answer change, and change to the expected one; and which artefacts changed.

    original, changed: base_id, pred_answer, memory_key, retrieval_key, prompt_key; expected: base_id, expected_answer
    """
    b = changed.select("base_id", *[F.col(c).alias(f"_{c}") for c in ("pred_answer", "memory_key", "retrieval_key", "prompt_key")])
    j = original.join(b, "base_id").join(expected, "base_id", "left")
    was, now, want = tx.text_of("pred_answer"), tx.text_of("_pred_answer"), tx.text_of("expected_answer")
    moved = tx.strip(was) != tx.strip(now)
    rule = F.when(want == "", moved).when(tx.normalize_answer(now) == tx.normalize_answer(want), True).when(tx.normalize_answer(was) == tx.normalize_answer(now), False)
    if verdicts is not None:
        j = j.join(verdicts.select("base_id", "verdict"), "base_id", "left")
        rule = F.coalesce(rule, F.col("verdict"))
    diff = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.select("base_id", moved.alias("answer_changed"), F.coalesce(rule, F.lit(False)).cast("int").alias("CSS"), diff("memory_key").alias("memory_changed"),
                    diff("retrieval_key").alias("retrieval_changed"), diff("prompt_key").alias("prompt_changed"))


def e2e_row(encoding: DataFrame, organization: DataFrame, retrieval: DataFrame, injection: DataFrame, utilization: DataFrame) -> DataFrame:
    """One flat row of headline metrics per sample."""
    out = encoding
    for df in (organization, retrieval, injection, utilization):
        out = out.join(df, "sample_id", "full_outer")
    return out


METRICS = ("Acc", "Q_FCR", "RDR", "CMR", "CMR_M", "OQG", "CP_ratio", "RFR", "RAG", "MRR", "CMR_R", "PCR", "TL", "PS", "CMR_P")


def stage_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-ignoring means by keys; empty means stay null."""
    have = [m for m in METRICS if m in rows.columns]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_samples"), *[mean_null(F.col(m)).alias(m) for m in have])


def system_summary(rows: DataFrame) -> DataFrame:
    return stage_summary(rows, ["dataset", "system"])


def task_summary(rows: DataFrame) -> DataFrame:
    return stage_summary(rows, ["dataset", "system", "task_type", "question_type"])


def contradiction_flow(rows: DataFrame, keys: Sequence[str] = ("dataset", "system", "task_type", "question_type")) -> DataFrame:
    """How often a contradiction in memory reaches retrieval, and in retrieval reaches the prompt."""
    m, r, p = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("CMR_M", "CMR_R", "CMR_P"))
    n = F.count_if
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"), *[mean_null(F.col(c)).alias(f"{c}_rate") for c in ("CMR_M", "CMR_R", "CMR_P")], n(m).alias("num_with_CMR_M"), n(r).alias("num_with_CMR_R"), n(p).alias("num_with_CMR_P"),
        F.try_divide(n(m & r), n(m)).alias("M_to_R"), F.try_divide(n(r & p), n(r)).alias("R_to_P"), F.try_divide(n(m & p), n(m)).alias("M_to_P"))


def utilization_gap(rows: DataFrame, q_fcr: float = 0.65, rfr: float = 0.70, pcr: float = 0.70, keys: Sequence[str] = ("dataset", "task_type", "question_type")) -> DataFrame:
    """Accuracy where everything before the answer went well, against full context on the same samples; a missing flag counts as 0."""
    from .joins import with_full_context
    star = F.coalesce((F.col("Q_FCR") > q_fcr) & (F.col("RFR") >= rfr) & (F.col("PCR") > pcr) & (F.col("CMR_P") == 0), F.lit(False))
    r = with_full_context(rows.withColumn("Acc", F.coalesce(F.col("Acc").cast("double"), F.lit(0.0))), [*keys, "sample_id"])
    own = F.avg(F.when(star, F.col("Acc")))
    full = F.avg(F.when(star, F.col("full_Acc")))
    return r.groupBy("system", *keys).agg(F.count(F.lit(1)).alias("num_samples"), F.count_if(star).alias("T_star_size"), F.avg("Acc").alias("Acc_all"), own.alias("Acc_T_star"),
                                          full.alias("FullContext_T_star"), (full - own).alias("UG"))
