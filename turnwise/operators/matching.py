"""Exact text matching joins that never compare every pair of a group.

Containment and coverage are found through keys both sides must share: a rare inner word,
a character gram of a short string, or the rare words a covered set cannot all miss.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scale import keyed_join

#: Anchor lengths of the gram join, longest first.
GRAMS = (16, 8, 4, 2, 1)


def _grams(text: Column, n: int) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))))


def gram_pairs(needles: DataFrame, strings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(needle, string) pairs with needle inside string. Meant for short strings (names, words).

    needles: keys, needle; strings: keys, string — both distinct. A needle is looked up by its
    leading gram of the longest anchor length it fills; an empty needle is in every string.
    """
    size = F.coalesce(*[F.when(F.length("needle") >= n, F.lit(n)) for n in GRAMS], F.lit(0))
    n = needles.withColumn("_n", size).withColumn("_g", F.col("needle").substr(F.lit(1), F.col("_n")))
    # strings are cut only into the gram lengths some needle of their scope is looked up by
    sizes = n.groupBy(*keys).agg(F.collect_set("_n").alias("_sizes"))
    asked = keyed_join(strings.select(*keys, "string"), sizes, keys, "string", size_of=needles)

    def tagged(size):
        return F.when(F.array_contains("_sizes", size), F.transform(_grams(F.col("string"), size), lambda x: F.struct(F.lit(size).alias("n"), x.alias("g"))))

    empty = F.when(F.array_contains("_sizes", 0), F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("g"))))
    each = F.flatten(F.array_compact(F.array(*[tagged(g) for g in GRAMS], empty)))
    s = asked.select(*keys, "string", F.explode(each).alias("e")).select(*keys, "string", F.col("e.n").alias("_n"), F.col("e.g").alias("_g"))
    return n.join(s, [*keys, "_n", "_g"]).where(F.contains("string", F.col("needle"))).select(*keys, "needle", "string")


def rare_first(left: DataFrame, right: DataFrame, keys: Sequence[str], lid: str, words: str, rwords: str) -> DataFrame:
    """The words of each left row, numbered from rarest to commonest on the right side."""
    lw = left.select(*keys, lid, F.explode(F.array_distinct(words)).alias("w"))
    rw = right.select(*keys, F.explode(F.array_distinct(rwords)).alias("w"))
    df = rw.join(lw.select(*keys, "w").distinct(), [*keys, "w"], "left_semi").groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("df"))
    w = W.partitionBy(*keys, lid).orderBy(F.coalesce("df", F.lit(0)), "w")
    return lw.join(df, [*keys, "w"], "left").withColumn("place", F.row_number().over(w))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], lid: str, rid: str,
                  ratio: float, strict: bool = False) -> DataFrame:
    """Pairs sharing at least `ratio` of the left row's distinct words (`lw`, `rw` are the word arrays).

    A pair that qualifies must share one of the left row's n-m+1 rarest words (m = the least
    overlap that qualifies), so only those words are joined on; the overlap is then counted
    on the arrays themselves.
    """
    L = left.select(*keys, lid, F.array_distinct("lw").alias("lw")).where(F.size("lw") > 0)
    R = right.select(*keys, rid, F.array_distinct("rw").alias("rw")).where(F.size("rw") > 0)
    n = F.size("lw")
    need = F.floor(n * ratio + 1e-9) + 1 if strict else F.ceil(n * ratio - 1e-9)
    need = F.greatest(need, F.lit(1)).cast("int")
    probe = rare_first(L, R, keys, lid, "lw", "rw").join(L.select(*keys, lid, (n - need + 1).alias("_p")), [*keys, lid]).where(
        F.col("place") <= F.col("_p")).select(*keys, lid, "w")
    words = R.select(*keys, rid, F.explode("rw").alias("w"))
    cand = probe.join(words, [*keys, "w"]).select(*keys, lid, rid).distinct()
    j = cand.join(L, [*keys, lid]).join(R, [*keys, rid])
    j = j.withColumn("overlap", F.size(F.array_intersect("lw", "rw"))).withColumn("ratio", F.col("overlap") / F.size("lw"))
    return j.where(F.col("overlap") >= need).select(*keys, lid, rid, "overlap", "ratio")


def contains_pairs(needles: DataFrame, hay: DataFrame, keys: Sequence[str], nid: str, hid: str) -> DataFrame:
    """Pairs with the needle's text inside the hay's; both are single-spaced normalised text (`nt`, `ht`).

    A needle of three words or more must have its inner words whole in the hay: it is joined on
    the rarest. Shorter needles are matched to the distinct words and word pairs of the hay.
    """
    N = needles.select(*keys, nid, "nt").where(F.col("nt") != "").withColumn("_w", F.split("nt", " "))
    H = hay.select(*keys, hid, "ht").where(F.col("ht") != "").withColumn("_h", F.split("ht", " "))
    inner = N.where(F.size("_w") >= 3).withColumn("_in", F.slice("_w", F.lit(2), F.size("_w") - 2))
    anchor = rare_first(inner, H, keys, nid, "_in", "_h").where("place = 1").select(*keys, nid, "w")
    hw = H.select(*keys, hid, F.explode(F.array_distinct("_h")).alias("w"))
    long_ = anchor.join(hw, [*keys, "w"]).select(*keys, nid, hid).join(N.select(*keys, nid, "nt"), [*keys, nid]).join(
        H.select(*keys, hid, "ht"), [*keys, hid]).where(F.contains("ht", F.col("nt"))).select(*keys, nid, hid)
    short = N.where(F.size("_w") < 3).select(*keys, nid, F.col("nt").alias("needle"), (F.size("_w") == 2).alias("_two"))
    # only scopes with short needles give up their words, and word pairs only where a needle has two words
    scopes = short.groupBy(*keys).agg(F.max("_two").alias("_two"))
    near = keyed_join(H, scopes, keys, hid, size_of=needles)
    short = short.drop("_two")
    pairs = F.zip_with(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0))), F.slice("_h", F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    pieces = F.when(F.col("_two"), F.concat("_h", pairs)).otherwise(F.col("_h"))
    hp = near.select(*keys, hid, F.explode(F.array_distinct(pieces)).alias("string"))
    gp = gram_pairs(short.select(*keys, "needle").distinct(), hp.select(*keys, "string").distinct(), keys)
    # a needle may stand in many words of one hay, and many rows may ask for the same needle
    found = gp.join(hp, [*keys, "string"]).select(*keys, "needle", hid).distinct()
    short_ = short.join(found, [*keys, "needle"]).select(*keys, nid, hid)
    return long_.unionByName(short_).distinct()
