"""The training-data pipeline: quality rules, exact and near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared folder and
reads it again as the next stage's docs. All stages but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import bpe, exact, jaccard, mixing, rules
from turnwise.llm.queries import tokenizer
from turnwise.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: too short, too repetitive, or far from their language and source (rules: `rules.judge`).

    A null or empty text has no words and goes; a very long text is judged whole; rows that are repeated are judged alike;
    null languages and sources are groups of their own; no rows give no rows; all columns stay as they were.
    """
    return rules.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z as a-z) the row with the largest doc_id stays, a null id last.

    Null and empty texts are one text; of rows that share even the id one stays; no rows give no rows; all columns stay.
    """
    return exact.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the least doc_id stays.

    Texts without words are linked with none and stay; very long texts are compared whole; of rows that share id and text one
    stays; a row with a null id stays where no other row is reached; no rows give no rows; all columns stay.
    """
    return jaccard.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole copies, up to three and rounded to hit its source's target.

    Texts without words have no size and are not taken; a null source is a source; repeated rows are taken each; no rows give
    no rows; all columns stay.
    """
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document of the mix, repeated ones each.

    Null and empty texts have no tokens; very long texts are encoded whole; no rows give no rows.
    """
    return bpe.digests(bpe.encode_documents(docs, *tokenizer()))


STAGES = [("quality rules", quality_rules), ("exact duplicates", exact_duplicates), ("near duplicates", near_duplicates), ("mixing", mixed_sources), ("encoding", encoded)]

#: Component search, the cube method and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
