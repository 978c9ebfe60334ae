"""Exact deduplication behind a Bloom filter of possibly repeated hashes. DataFrame functions only.

Pass one counts how often each filter position is hit and keeps the positions hit at least twice as bitmaps.
Pass two tests every row against them: a repeated text hits only kept positions, so a row with a position that was hit
once is unique and goes straight through. The others, and only they, are shuffled and compared exactly.

The bitmaps are broadcast; their size is a parameter (`MAX_BITS`, 32 MiB), whatever the input. A filter too small for its
input lets more rows through to the exact step and changes no result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Filter positions per row, and bits per position when the input is small enough.
PROBES, BITS_PER_PROBE = 2, 8
#: Bits of the largest filter: 2^28 bits are 8,192 bitmaps of 4 KiB.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z, and nothing else, in lower case; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (rows * PROBES * BITS_PER_PROBE - 1).bit_length())) if rows else MIN_BITS


def _probe(sha: Column, k: int, bits: int) -> Column:
    """Position 1..bits of a hash for probe k."""
    return F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(bits)) + F.lit(1)


def repeated_bitmaps(hashes: DataFrame, bits: int, least: int = 2) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the filter positions that `least` or more rows of `hashes` (_sha) hit."""
    hits = (hashes.select(F.explode(F.array_distinct(F.array(*[_probe(F.col("_sha"), k, bits) for k in range(PROBES)]))).alias("p"))
            .groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    return hits.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bitmap"))


def possibly_repeated(df: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """`df` (_sha, …) with _maybe: false only where the hash certainly occurs once. No row of `df` is shuffled."""
    maybe = F.lit(True)
    for k in range(PROBES):
        pos = _probe(F.col("_sha"), k, bits)
        df = df.withColumn(f"_b{k}", F.bitmap_bucket_number(pos)).withColumn(f"_p{k}", F.bitmap_bit_position(pos).cast("int"))
        side = bitmaps.select(F.col("_bucket").alias(f"_b{k}"), F.col("_bitmap").alias(f"_m{k}"))
        df = df.join(F.broadcast(side), f"_b{k}", "left")
        byte = F.conv(F.hex(F.expr(f"substring(_m{k}, _p{k} div 8 + 1, 1)")), 16, 10).cast("int")
        maybe = maybe & F.coalesce(F.expr(f"_p{k} % 8").isNotNull() & (F.getbit(byte, F.expr(f"_p{k} % 8")) == 1), F.lit(False))
    return df.withColumn("_maybe", maybe).drop(*[f"_{c}{k}" for c in "bpm" for k in range(PROBES)])


def _hashes(docs: DataFrame) -> DataFrame:
    """One short row (_id, _sha) per document, written once."""
    return cut_lineage(docs.select(F.col("doc_id").alias("_id"), F.sha2(ascii_lower(F.col("text")), 256).alias("_sha")))


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null and empty are the same text. Of equal texts the row with
    the largest doc_id stays (a null id loses to any other). Of rows that share even that id one stays. No rows give no
    rows; other columns are ignored.
    """
    hashes = _hashes(docs)
    bits = filter_bits(hashes.count())
    tested = possibly_repeated(hashes, repeated_bitmaps(hashes, bits), bits)
    single = tested.where(~F.col("_maybe")).select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"))
    maybe = tested.where("_maybe").select("_id", "_sha")
    groups = maybe.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # A tie on (text, id) is numbered; hashing on both spreads a hot text over all tasks.
    numbered = maybe.withColumn("_n", F.row_number().over(W.partitionBy("_sha", "_id").orderBy("_id")))
    several = numbered.join(groups, "_sha").select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"))
    return single.unionByName(several)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns as they were (rules: `decide`).

    Only rows that may be repeated are shuffled with their texts, hashed on (text hash, doc_id), so that a text held by a
    third of all rows is spread; the rest never leave their task.
    """
    hashes = _hashes(docs)
    bits = filter_bits(hashes.count())
    bitmaps = cut_lineage(repeated_bitmaps(hashes, bits))
    stays = (possibly_repeated(hashes, bitmaps, bits).where("_maybe").groupBy("_sha").agg(F.max("_id").alias("_keep")))
    rows = possibly_repeated(docs.select(F.struct("*").alias("_row"), F.sha2(ascii_lower(F.col("text")), 256).alias("_sha")), bitmaps, bits)
    single = rows.where(~F.col("_maybe")).select("_row.*")
    maybe = rows.where("_maybe").select("_row", "_sha", F.col("_row.doc_id").alias("_id"))
    kept = maybe.join(stays.withColumnRenamed("_sha", "_ks"), (F.col("_sha") == F.col("_ks")) & F.col("_id").eqNullSafe(F.col("_keep")))
    one = kept.withColumn("_n", F.row_number().over(W.partitionBy("_sha", "_id").orderBy(F.xxhash64(F.to_json("_row"))))).where("_n = 1")
    return single.unionByName(one.select("_row.*"))
