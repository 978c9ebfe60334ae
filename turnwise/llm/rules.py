"""Quality rules by robust multivariate outliers. DataFrame functions only.

Every text gives four statistics. Per language and source a minimum-covariance-determinant estimate is made by
concentration steps: distances under the current estimate, the 75 % of rows nearest to it, mean and covariance of those.
The steps go from several starts until the determinant no longer falls; the least determinant of a group gives its
estimate. Each step is one aggregation over (group, start, distance bin), so no group is gathered or sorted. A row is
rejected when its Mahalanobis distance under that estimate is beyond the cutoff.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .exact import filter_bits, possibly_repeated, repeated_bitmaps

SPACE = "[\\x20\\x09-\\x0D]"
DIMENSIONS = 4
#: Part of a group's rows the estimate is made from, and the chi-square factor that makes its covariance consistent.
PART, CONSISTENCY = 0.75, 1.49
#: Starts of a few rows each, and the fall of the logarithm of the determinant that calls for another step.
FEW_STARTS, SETTLED = 4, 1e-4
#: Squared distance beyond which a row is rejected (the 1 - 1e-8 quantile of chi-square with four degrees is 43).
CUTOFF = 60.0
#: Least standard deviation of each statistic, so that groups in which a statistic is constant have an estimate too.
FLOORS = (0.08, 0.12, 0.12, 0.10)
#: Groups with fewer rows are estimated together with the other small groups of their language, then with all others.
MIN_GROUP = 64
#: Distance bins per unit of ln(1 + d²).
BINS = 64


def text_statistics(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE + "+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return [words.alias("_words"), (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"), lines.alias("_lines")]


def repeat_words(words: str) -> Column:
    """Words of array column `words` in 8-word windows found twice or more.

    Windows are compared by 64-bit hashes. Texts without a repeated window, nearly all, need no sort.
    """
    hashes = f"transform(sequence(1, size({words}) - 7), i -> xxhash64(slice({words}, i, 8)))"
    # Sorted by (hash, position), a repeated window stands beside an equal one; the words it covers are added up in order.
    ordered = "sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i)))"
    starts = ("sort_array(transform(filter(transform(sequence(0, size(_s) - 1), j -> struct(_s[j].i AS i, (j > 0 AND _s[j].h = _s[greatest(j - 1, 0)].h) "
              "OR (j < size(_s) - 1 AND _s[j].h = _s[least(j + 1, size(_s) - 1)].h) AS r)), x -> x.r), x -> x.i))")
    covered = "aggregate(_r, struct(0L AS n, -1 AS e), (a, s) -> struct(a.n + (s + 8 - greatest(s, a.e)) AS n, s + 8 AS e), a -> a.n)"
    with_h = lambda body, h: f"element_at(transform(array({h}), _h -> {body}), 1)"
    with_s = f"element_at(transform(array({ordered}), _s -> element_at(transform(array({starts}), _r -> {covered}), 1)), 1)"
    return F.expr(f"CASE WHEN size({words}) < 9 THEN 0L ELSE {with_h(f'CASE WHEN size(array_distinct(_h)) = size(_h) THEN 0L ELSE {with_s} END', hashes)} END")


def statistics(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carried` columns, lang, source, the counts of the rules and base_failed per row of `docs`, in one pass without a shuffle."""
    parts = docs.select(*carried, "lang", "source", *text_statistics(F.col("text")))
    counted = parts.select(
        *carried, "lang", "source", F.size("_words").cast("bigint").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"), "n_symbols",
        F.size("_lines").cast("bigint").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words("_words").alias("n_repeat_words"))
    return counted.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


#: The statistic vector, each part on a scale on which ordinary texts lie close together. Spark and DuckDB read it alike.
VECTOR = ("ln(word_chars / CAST(n_words AS DOUBLE))", "sqrt(n_symbols / CAST(n_words AS DOUBLE))", "sqrt(n_dup_lines / CAST(n_lines AS DOUBLE))",
          "sqrt(n_repeat_words / CAST(n_words AS DOUBLE))")
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def cholesky_columns(df: DataFrame) -> DataFrame:
    """The factor of the covariance s.. as columns l.., one after the other."""
    for i in range(DIMENSIONS):
        for j in range(i):
            df = df.withColumn(f"l{i}{j}", F.expr(f"(s{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j}"))
        df = df.withColumn(f"l{i}{i}", F.expr(f"sqrt(greatest(1e-9, s{i}{i}" + "".join(f" - l{i}{k} * l{i}{k}" for k in range(i)) + "))"))
    return df


def squared_distance(df: DataFrame) -> DataFrame:
    """`df` (x.., m.., l..) with d2."""
    for i in range(DIMENSIONS):
        df = df.withColumn(f"z{i}", F.expr(f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}"))
    return df.withColumn("d2", F.expr(" + ".join(f"z{i} * z{i}" for i in range(DIMENSIONS)))).drop(*[f"z{i}" for i in range(DIMENSIONS)])


def moments(rows: DataFrame, keys: list[str], centre: list[str]) -> DataFrame:
    """Count, sums and sums of products of x.. - centre.. per key."""
    y = [F.col(f"x{i}") - F.expr(centre[i]) for i in range(DIMENSIONS)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(y[i]).alias(f"t{i}") for i in range(DIMENSIONS)],
                                   *[F.sum(y[i] * y[j]).alias(f"q{i}{j}") for i, j in PAIRS], *[F.first(F.expr(centre[i])).alias(f"c{i}") for i in range(DIMENSIONS)])


def estimate(m: DataFrame, factor: float) -> DataFrame:
    """key, start, was, mean m.., covariance s.. (rounded, so that the order of summation does not show) and its factor; ln_det."""
    cols = ["key", "start", "was", *[F.expr(f"round(c{i} + t{i} / n, 9)").alias(f"m{i}") for i in range(DIMENSIONS)]]
    for i, j in PAIRS:
        cov = f"round({factor} * (q{i}{j} / n - t{i} / n * (t{j} / n)), 9)"
        cols.append(F.expr(f"greatest({cov}, {FLOORS[i] ** 2!r})" if i == j else cov).alias(f"s{i}{j}"))
    return cholesky_columns(m.select(*cols)).withColumn("ln_det", F.expr("round(2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(DIMENSIONS)) + "), 9)"))


def starts(rows: DataFrame) -> DataFrame:
    """First estimates per group: of all rows, of medians and median deviations, of a few rows drawn by fixed hashes.

    Rows are drawn by the hash of their values, so equal ones count once.
    """
    x = [f"x{i}" for i in range(DIMENSIONS)]
    plain = estimate(moments(rows, ["key"], ["0D"] * DIMENSIONS).select("*", F.lit(0).alias("start"), F.lit(None).cast("double").alias("was")), 1.0)
    middle = cut_lineage(rows.groupBy("key").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"c{i}") for i, c in enumerate(x)]))
    spread = rows.join(middle, "key").groupBy("key").agg(F.lit(1).alias("start"), F.lit(None).cast("double").alias("was"), F.lit(1).alias("n"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(DIMENSIONS)],
                                                         *[F.percentile_approx(F.abs(F.col(c) - F.col(f"c{i}")), 0.5, 10_000).alias(f"d{i}") for i, c in enumerate(x)])
    robust = estimate(spread.select("*", *[F.lit(0.0).alias(f"t{i}") for i in range(DIMENSIONS)],
                                    *[F.expr(f"pow(1.4826 * d{i}, 2)" if i == j else "0D").alias(f"q{i}{j}") for i, j in PAIRS]), 1.0)
    drawn = (rows.withColumn("start", F.explode(F.array(*[F.lit(2 + k) for k in range(FEW_STARTS)]))).withColumn("_h", F.xxhash64("start", *x))
             .groupBy("key", "start", F.pmod("_h", F.lit(DIMENSIONS + 1)).alias("_part")).agg(F.min(F.struct("_h", *x)).alias("_r")).select("key", "start", "_r.*"))
    few = estimate(moments(drawn, ["key", "start"], ["0D"] * DIMENSIONS).withColumn("was", F.lit(None).cast("double")), 1.0)
    return plain.unionByName(robust).unionByName(few).withColumn("ln_det", F.lit(None).cast("double"))


def concentrate(rows: DataFrame, current: DataFrame) -> DataFrame:
    """One concentration step per start: the nearest `PART` of each group's rows under `current` give the next estimate; `was` is the ln_det before."""
    placed = squared_distance(rows.join(current, "key")).withColumn("bin", F.expr(f"CAST(floor(ln(1 + d2) * {BINS}) AS INT)"))
    binned = moments(placed, ["key", "start", "bin"], [f"m{i}" for i in range(DIMENSIONS)])
    of = W.partitionBy("key", "start")
    near = (binned.withColumn("before", F.sum("n").over(of.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(of))
            .where(f"before < {PART} * all"))
    sums = near.groupBy("key", "start").agg(F.sum("n").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(DIMENSIONS)], *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in PAIRS],
                                            *[F.first(f"c{i}").alias(f"c{i}") for i in range(DIMENSIONS)])
    sums = sums.join(current.select("key", "start", F.col("ln_det").alias("was")), ["key", "start"])
    return estimate(sums, CONSISTENCY)


def code(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def group_sizes(rows: DataFrame) -> DataFrame:
    """Rows of each language (_l) and source (_ls), as a written table."""
    return cut_lineage(rows.groupBy(code("lang").alias("_l"), F.concat_ws("\x1f", code("lang"), code("source")).alias("_ls")).agg(F.count(F.lit(1)).alias("n")))


def keyed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with key, the name of their group; null is a value of its own.

    Groups of language and source with `MIN_GROUP` rows in `sizes` are named by both, the others by their language where
    together they have as many, else "*". The lists are broadcast while they are small; that is left to the planner.
    """
    fine = sizes.where(F.col("n") >= MIN_GROUP).select("_ls", F.col("_ls").alias("_fine"))
    wide = sizes.where(F.col("n") < MIN_GROUP).groupBy("_l").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_GROUP).select("_l", F.col("_l").alias("_wide"))
    return (rows.withColumn("_l", code("lang")).withColumn("_ls", F.concat_ws("\x1f", code("lang"), code("source"))).join(fine, "_ls", "left").join(wide, "_l", "left")
            .withColumn("key", F.coalesce("_fine", "_wide", F.lit("*"))).drop("_l", "_ls", "_fine", "_wide"))


@dataclass
class Estimates:
    """What a corpus says of its groups: the sizes of all, mean and covariance factor by key. Both are written tables."""
    sizes: DataFrame
    by_key: DataFrame

    def verdicts(self, stats: DataFrame) -> DataFrame:
        """`stats` with distance (null where base_failed) and kept."""
        vectors = vectors_of(keyed(stats, self.sizes))
        far = squared_distance(vectors.join(self.by_key, "key", "left")).withColumnRenamed("d2", "distance")
        return far.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF))


def vectors_of(stats: DataFrame) -> DataFrame:
    """`stats` with the statistic vector x.., null where base_failed."""
    return stats.select("*", *[F.when(~F.col("base_failed"), F.expr(v)).alias(f"x{i}") for i, v in enumerate(VECTOR)])


def fit(stats: DataFrame) -> Estimates:
    """Minimum-covariance-determinant estimates from a written table of statistics."""
    sound = stats.where("NOT base_failed")
    sizes = group_sizes(sound)
    rows = cut_lineage(vectors_of(keyed(sound, sizes)).select("key", *[f"x{i}" for i in range(DIMENSIONS)]))
    # Written, so that the planner knows how large the estimates are when it joins them.
    current, ends = cut_lineage(starts(rows)), None
    falls = F.coalesce(F.col("ln_det") < F.col("was") - SETTLED, F.lit(True))
    while not current.isEmpty():
        # Each fall is SETTLED or more and the determinant has a floor, so this ends.
        stepped = cut_lineage(concentrate(rows, current))
        end = stepped.where(~falls)
        ends, current = end if ends is None else ends.unionByName(end), stepped.where(falls)
    least = (current if ends is None else ends).groupBy("key").agg(F.min_by(F.struct("*"), F.struct("ln_det", "start")).alias("_e"))
    return Estimates(sizes, cut_lineage(least.select("_e.*").drop("start", "was", "ln_det")))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, lang, source, text): the rules' counts, base_failed, distance, kept.

    A text fails at once with under 20 words (a null or empty text has none) or with over 30 % of its words in repeated
    8-word windows. The others are kept unless their statistics lie beyond `CUTOFF` in their group. Null is a language or
    source of its own. Repeated rows are judged each, alike; no rows give no rows; other columns are ignored.
    """
    stats = cut_lineage(statistics(docs))
    return fit(stats).verdicts(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, all columns as they were.

    Verdicts are short rows, named by id and a hash of what they rest on. Rows that miss a filter of the rejected hashes stay
    where they are; the others, few more than are rejected, meet the rejected names in an anti-join.
    """
    seen = F.xxhash64("text", "lang", "source")
    stats = cut_lineage(statistics(docs.withColumn("_seen", seen), ("doc_id", "_seen")))
    out = cut_lineage(fit(stats).verdicts(stats).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("_seen").alias("_key")).distinct())
    bits = filter_bits(out.count())
    bitmaps = cut_lineage(repeated_bitmaps(out.select(F.col("_key").alias("_sha")), bits, 1))
    rows = possibly_repeated(docs.select(F.struct("*").alias("_row"), seen.alias("_sha")), bitmaps, bits)
    maybe = rows.where("_maybe").join(out, (F.col("_sha") == F.col("_key")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return rows.where(~F.col("_maybe")).select("_row.*").unionByName(maybe.select("_row.*"))
