"""Named memory systems as DataFrame functions: (turns, queries, k) -> entries, retrieved, prompts.

A system is a plain function; the registry carries its lifecycle so runs can pick the supported ones.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .functions import text as tx
from .operators import corpus, fusion, lanes


@dataclass
class Run:
    entries: DataFrame
    retrieved: DataFrame
    prompts: DataFrame


@dataclass
class System:
    name: str
    run: Callable[[DataFrame, DataFrame, int], Run]
    lifecycle: str = "analysis_only"


REGISTRY: dict[str, System] = {}
# Lifecycles that a run leaves out unless it asks for them.
PAST = ("historical", "historical_reference")


def system(name: str, lifecycle: str = "analysis_only"):
    def keep(fn):
        REGISTRY[name] = System(name, fn, lifecycle)
        return fn
    return keep


def available(lifecycle: str | None = None) -> list[str]:
    """Names of the systems of a lifecycle; without one, of all that are not past."""
    return sorted(n for n, s in REGISTRY.items() if (s.lifecycle == lifecycle if lifecycle else s.lifecycle not in PAST))


def build(name: str) -> System:
    key = name.strip().lower()
    if key not in REGISTRY:
        raise KeyError(f"unknown memory system {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[key]


def _prompts(retrieved: DataFrame, queries: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- [memory_id="), "entry_id", F.lit("] "), tx.normalize_text("content"))
    return fusion.prompts(retrieved.select("sample_id", "rank", "entry_id", line.alias("line")), queries.select("sample_id", F.col("query_text").alias("question")))


def _entries(turns: DataFrame) -> DataFrame:
    return corpus.turn_entries(turns).join(turns.select("conversation_id", "pos", "raw_id"), ["conversation_id", "pos"])


@system("no_memory", "active_control")
def no_memory(turns: DataFrame, queries: DataFrame, k: int) -> Run:
    """The lower bound: nothing is stored, retrieved or injected."""
    e = _entries(turns).limit(0)
    r = queries.select("sample_id", "conversation_id").limit(0).select("sample_id", F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("entry_id"), F.lit("").alias("content"), F.lit(0.0).alias("score"))
    return Run(e, r, _prompts(r, queries))


@system("full_context", "active_control")
def full_context(turns: DataFrame, queries: DataFrame, k: int) -> Run:
    """The upper bound: every turn in order with score 1.

    The history is not copied per question: `retrieved` holds it once per conversation (sample_id = conversation),
    and the prompt table is the rendered lines of the conversation, one row per turn.
    """
    e = _entries(turns)
    r = e.select(F.col("conversation_id").alias("sample_id"), (F.col("pos") + 1).cast("bigint").alias("rank"), "entry_id", "content", F.lit(1.0).alias("score"))
    return Run(e, r, corpus.render_sessions(turns))


def _ranked(lane: DataFrame, e: DataFrame) -> DataFrame:
    return lane.join(e.select("raw_id", "entry_id", "content"), "raw_id").select("sample_id", "rank", "entry_id", "content", "score")


@system("simple_vector_tfidf")
def simple_vector_tfidf(turns: DataFrame, queries: DataFrame, k: int) -> Run:
    """TF-IDF cosine over turn entries."""
    e = _entries(turns)
    docs = e.select("conversation_id", "raw_id", F.col("content").alias("text"), F.col("pos").alias("ord"))
    r = _ranked(lanes.tfidf_cosine(queries, docs, depth=k), e)
    return Run(e, r, _prompts(r, queries))


def current_entries(turns: DataFrame) -> DataFrame:
    """A turn's memory texts, each an entry of its own; the turn itself where it has none.

    turns: …, current_memory_texts (array<string>, may be null or missing)
    """
    texts = F.col("current_memory_texts") if "current_memory_texts" in turns.columns else F.lit(None).cast("array<string>")
    t = turns.withColumn("_m", F.coalesce(texts, F.array().cast("array<string>")))
    own = t.select("conversation_id", "pos", "raw_id", "turn_id", F.posexplode("_m").alias("n", "m")).where(tx.strip(tx.text_of("m")) != "")
    own = own.select("conversation_id", "pos", (F.col("n") + 1).alias("n"), F.concat("raw_id", F.lit("#"), F.col("n") + 1).alias("raw_id"),
                     F.concat("turn_id", F.lit(":memory:"), F.col("n") + 1).alias("entry_id"), tx.strip(F.col("m")).alias("content"))
    bare = t.where((F.size("_m") == 0) & (tx.strip(tx.text_of("text")) != "")).select(
        "conversation_id", "pos", F.lit(0).alias("n"), "raw_id", F.col("turn_id").alias("entry_id"), F.concat(F.coalesce("speaker", F.lit("unknown")), F.lit(": "), tx.strip(F.col("text"))).alias("content"))
    return own.unionByName(bare)


@system("current_memory")
def current_memory(turns: DataFrame, queries: DataFrame, k: int) -> Run:
    """TF-IDF cosine over what a turn is remembered by, or over the turn."""
    e = current_entries(turns)
    docs = e.select("conversation_id", "raw_id", F.col("content").alias("text"), F.struct("pos", "n").alias("ord"))
    r = _ranked(lanes.tfidf_cosine(queries, docs, depth=k), e)
    return Run(e, r, _prompts(r, queries))


@system("lexical_fallback")
def lexical_fallback(turns: DataFrame, queries: DataFrame, k: int) -> Run:
    """Term overlap over turn entries, store order on ties."""
    e = _entries(turns)
    docs = e.select("conversation_id", "raw_id", F.col("content").alias("text"), F.col("pos").alias("ord"))
    r = _ranked(lanes.term_overlap(queries, docs, depth=k), e)
    return Run(e, r, _prompts(r, queries))


@system("passages", "supplementary")
def passage_system(turns: DataFrame, queries: DataFrame, k: int) -> Run:
    """Archive passages of eight turns by shared terms with a phrase bonus."""
    p = corpus.passages(turns, 8).withColumn("raw_id", F.concat_ws("::p", "conversation_id", "passage"))
    docs = p.select("conversation_id", "raw_id", F.col("content").alias("text"), F.col("passage").alias("ord"))
    e = p.select("conversation_id", "raw_id", F.col("raw_id").alias("entry_id"), "content")
    r = _ranked(lanes.passage_lane(queries, docs, k), e)
    return Run(e, r, _prompts(r, queries))


def run_all(names: list[str], turns: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Retrieved rows of several systems as one table."""
    out = None
    for n in names:
        r = build(n).run(turns, queries, k).retrieved.select(F.lit(n).alias("system"), "sample_id", "rank", "entry_id", "score")
        out = r if out is None else out.unionByName(r)
    return out
