"""Nested memory records to relational tables, and the stores built over turns.

A *turns* table has conversation_id, raw_id, turn_id, session_id, pos (position in the
conversation), idx (position in the session), speaker, timestamp and text. Lists that
grow with a conversation are kept as child rows, never as one array per conversation.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx
from .scale import ordinal

#: Positions per window block; a hot session is cut into blocks of this many turns.
BLOCK = 1024


def neighbors(turns: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
              cols: Sequence[str], out: str = "context") -> DataFrame:
    """Rows at positions pos-before … pos+after of the same key, the center left out.

    Each row is copied only into the blocks whose centers can see it, so the window is
    over (key, block) and never over a whole key.
    """
    p = F.col(pos)
    first, last = F.floor((p - after) / BLOCK), F.floor((p + before) / BLOCK)
    copies = turns.withColumn("_b", F.explode(F.sequence(first, last)))
    w = W.partitionBy(*keys, "_b").orderBy(pos).rangeBetween(-before, after)
    seen = copies.withColumn(out, F.collect_list(F.struct(pos, *cols)).over(w))
    return (seen.where(F.col("_b") == F.floor(p / BLOCK)).drop("_b")
            .withColumn(out, F.array_sort(F.filter(out, lambda x: x[pos] != p))))


def previous(turns: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the preceding row of the same key (null at the start)."""
    n = neighbors(turns, keys, pos, 1, 0, cols, "_prev")
    head = F.try_element_at("_prev", F.lit(1))
    return n.select(*turns.columns, *[head[c].alias(prefix + c) for c in cols])


# -- views -----------------------------------------------------------------

def doc_views(raws: DataFrame) -> DataFrame:
    """Clauses of a turn in three views: plain, with speaker, with speaker and time."""
    keep = [c for c in raws.columns if c != "raw_text"]
    c = raws.select(*keep, F.posexplode(tx.split_clauses("raw_text")).alias("_o", "plain"))
    return c.select(*keep, (F.col("_o") + 1).cast("bigint").alias("ord"), "plain",
                    tx.strip(F.concat_ws(" ", tx.text_of("speaker"), "plain")).alias("speaker_view"),
                    tx.strip(F.concat_ws(" ", tx.text_of("speaker"), tx.text_of("timestamp"), "plain")).alias("temporal"))


def fused_views(contracts: DataFrame) -> DataFrame:
    """Four query views of a contract, blank parts skipped."""
    events = F.array_join(F.filter("events", lambda x: x.isNotNull() & (x != "")), " | ")
    owner = F.coalesce(F.nullif("time_owner", F.lit("")), F.col("subject"))
    return contracts.select(
        "sample_id",
        tx.join_nonblank(" | ", F.col("subject"), F.col("evaluated_subject"), F.col("family"), F.col("direction")).alias("role_relation"),
        tx.join_nonblank(" | ", F.col("subject"), F.col("evaluated_subject"), events).alias("event"),
        tx.join_nonblank(" | ", owner, F.col("temporal"), events).alias("temporal"),
        tx.join_nonblank(" | ", F.col("subject"), F.col("evaluated_subject"), F.col("answer_role"), F.col("family")).alias("answer_slot"))


def history_messages(turns: DataFrame) -> DataFrame:
    """Per turn: chat role, plain content, content with a source header, numbered line."""
    body = tx.strip(tx.text_of("text"))
    who, tid = tx.nonblank("speaker"), tx.nonblank("turn_id")
    tag = lambda name, v: F.concat(F.lit(name + "="), v)
    header = F.concat_ws("; ", tag("turn_id", tid), tag("session_id", tx.nonblank("session_id")),
                         tag("session_date", tx.nonblank("timestamp")), tag("speaker", who))
    source = F.when(header == "", "[source]").otherwise(F.concat(F.lit("[source "), header, F.lit("]")))
    return turns.where(body != "").select(
        "conversation_id", "pos", tx.normalize_role("speaker").alias("role"), body.alias("content"),
        F.concat(source, F.lit("\n"), F.coalesce(F.concat(who, F.lit(": ")), F.lit("")), body).alias("sourced"),
        F.concat(F.lit("["), F.col("pos") + 1, F.lit("] "), F.coalesce(tx.nonblank("speaker"), F.lit("unknown")),
                 F.lit(": "), body).alias("line"))


def render_sessions(turns: DataFrame) -> DataFrame:
    """Full-history lines; a header line precedes a turn whose (session, date) changed."""
    shown = turns.where(tx.strip(tx.text_of("text")) != "")
    p = previous(shown, ["conversation_id"], "pos", ["session_id", "timestamp"])
    changed = ~(F.col("prev_session_id").eqNullSafe(F.col("session_id"))
                & F.col("prev_timestamp").eqNullSafe(F.col("timestamp")))
    head = F.concat(F.lit("[Session "), F.concat_ws(
        "; ", F.concat(F.lit("session_id="), tx.nonblank("session_id")),
        F.concat(F.lit("session_date="), tx.nonblank("timestamp"))), F.lit("]"))
    stamp = F.coalesce(tx.format_timestamp(tx.parse_timestamp("timestamp")), tx.nonblank("timestamp"))
    who = F.coalesce(tx.nonblank("speaker"), F.lit("unknown"))
    line = F.concat(F.coalesce(F.concat(F.lit("["), stamp, F.lit("] ")), F.lit("")), who, F.lit(": "),
                    tx.strip_speaker("text", "speaker"))
    return p.select("conversation_id", "pos", F.when(changed, head).alias("header"), line.alias("line"))


def history_index(turns: DataFrame) -> DataFrame:
    """One row per id a source list may cite: every turn id, and every session id not also a turn id."""
    info = F.struct("pos", F.col("session_id").alias("s"), F.col("timestamp").alias("d"), F.col("speaker").alias("w"))
    by_turn = turns.groupBy("conversation_id", F.col("turn_id").alias("source_id")).agg(F.max(info).alias("i"))
    by_session = turns.groupBy("conversation_id", F.col("session_id").alias("source_id")).agg(F.min(info).alias("i"))
    both = by_turn.withColumn("o", F.lit(0)).unionByName(by_session.withColumn("o", F.lit(1)))
    return (both.groupBy("conversation_id", "source_id").agg(F.min_by("i", "o").alias("i"))
            .select("conversation_id", "source_id", F.col("i.s").alias("src_session"), F.col("i.d").alias("src_date"),
                    F.col("i.w").alias("src_speaker")))


def render_memory(retrieved: DataFrame, turns: DataFrame) -> DataFrame:
    """One rendered line pair per retrieved entry, metadata falling back to the cited turn.

    retrieved: sample_id, conversation_id, rank, entry_id, content, source_ids, session_id,
    session_date, speaker.
    """
    cited = retrieved.select("sample_id", "rank", "conversation_id", F.posexplode("source_ids").alias("o", "source_id"))
    found = (cited.join(history_index(turns), ["conversation_id", "source_id"])
             .groupBy("sample_id", "rank").agg(F.min_by(F.struct("src_session", "src_date", "src_speaker"), "o").alias("m")))
    r = retrieved.join(found, ["sample_id", "rank"], "left")
    ids = F.array_join(F.filter("source_ids", lambda x: tx.strip(x) != ""), ",")
    speaker = F.coalesce(tx.nonblank("speaker"), tx.nonblank(F.col("m.src_speaker")))
    header = F.concat_ws(
        "; ", F.concat(F.lit("memory_id="), F.nullif("entry_id", F.lit(""))),
        F.concat(F.lit("source_ids="), F.nullif(ids, F.lit(""))),
        F.concat(F.lit("session_id="), F.coalesce(tx.nonblank("session_id"), tx.nonblank(F.col("m.src_session")))),
        F.concat(F.lit("session_date="), F.coalesce(tx.nonblank("session_date"), tx.nonblank(F.col("m.src_date")))),
        F.concat(F.lit("speaker="), speaker))
    head = F.when(header == "", "memory").otherwise(header)
    return r.select("sample_id", "rank", "entry_id", F.concat(
        F.lit("- ["), head, F.lit("]\n  "), tx.strip_speaker("content", speaker)).alias("line"))


# -- sidecar to tables -----------------------------------------------------

FACT = ("subject", "relation", "value", "event", "time")


def _fact_text(f: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(f[x].cast("string"), F.lit("")) for x in FACT])


def _base_text(b: Column, deduplicated: bool) -> Column:
    if deduplicated:
        return tx.render_assertion(b["retrieval_text"], b["subject"], b["surface_relation"], b["value"], b["event"], b["time"])
    return F.concat_ws(" ", *[F.coalesce(b[x].cast("string"), F.lit("")) for x in
                              ("subject", "surface_relation", "value", "retrieval_text")])


def _sig(f: Column, relation: str) -> Column:
    return F.concat_ws("\x01", *[F.lower(F.coalesce(f[x].cast("string"), F.lit("")))
                                 for x in ("subject", relation, "value")])


def assertions(sidecar: DataFrame, deduplicated: bool = False) -> DataFrame:
    """Speech-act, flat and base facts of a sidecar as one table.

    A base fact of a row with a contextual parse is skipped when its lower-cased
    (subject, relation, value) is already among that row's facts. Everything needed is
    in the row, so no join or shuffle is involved.
    """
    s = sidecar.withColumn("c", F.col("contextual"))
    none = F.array().cast("array<string>")
    acts = F.filter(F.transform(F.coalesce(F.col("c.speech_acts"), F.array()), lambda a, i: F.struct(
        i.alias("i"), a["assertion"].alias("f"))), lambda r: r["f"].isNotNull())
    flat = F.transform(F.coalesce(F.col("c.assertions"), F.array()), lambda a, i: F.struct(i.alias("i"), a.alias("f")))
    known = F.concat(F.transform(acts, lambda r: _sig(r["f"], "relation")), F.transform(flat, lambda r: _sig(r["f"], "relation")))
    base = F.transform(F.coalesce(F.col("base_l2_direct"), F.array()), lambda b, i: F.struct(
        i.alias("i"), b.alias("b"), _sig(b, "surface_relation").alias("s")))
    sigs = F.transform(base, lambda r: r["s"])
    fresh = F.when(F.col("c").isNull(), base).otherwise(F.filter(
        base, lambda r: ~F.array_contains(known, r["s"]) & (F.array_position(sigs, r["s"]) == r["i"] + 1)))

    def row(fid, f, text, authority, act, kind, i, modality, polarity):
        return F.struct(fid.alias("assertion_id"), *[f[x].cast("string").alias(x) for x in ("subject",)],
                        f["relation"].cast("string").alias("relation") if kind != 2 else f["surface_relation"].cast("string").alias("relation"),
                        f["value"].cast("string").alias("value"), f["event"].cast("string").alias("event"),
                        f["time"].cast("string").alias("time"), modality.alias("modality"), polarity.alias("polarity"),
                        text.alias("retrieval_text"), F.lit(authority).alias("authority"), act.alias("speech_act"),
                        F.lit(kind).alias("kind"), i.alias("ord"))

    rid = F.col("raw_id")
    rows = F.concat(
        F.transform(acts, lambda r: row(F.concat(rid, F.lit("::v41::a"), r["i"] + 1), r["f"], _fact_text(r["f"]),
                                        "CENTER_RAW", F.lit("ASSERTION"), 0, r["i"], r["f"]["modality"], r["f"]["polarity"])),
        F.transform(flat, lambda r: row(F.concat(rid, F.lit("::ctx::a"), r["i"] + 1), r["f"], _fact_text(r["f"]),
                                        "CENTER_RAW", F.coalesce(F.col("c.evidence_role"), F.lit("ASSERTION")), 1, r["i"],
                                        r["f"]["modality"], r["f"]["polarity"])),
        F.transform(fresh, lambda r: row(r["b"]["assertion_id"], r["b"], _base_text(r["b"], deduplicated),
                                         "BASE_VALIDATED", F.lit("ASSERTION"), 2, r["i"], r["b"]["modality"], r["b"]["polarity"])))
    return s.select("raw_id", F.substring_index("raw_id", "::", 1).alias("conversation_id"), F.explode(rows).alias("r")).select(
        "raw_id", "conversation_id", "r.*")


def propositions(sidecar: DataFrame) -> DataFrame:
    """Resolved propositions of speech acts, and one derived per flat assertion."""
    acts = sidecar.select("raw_id", F.posexplode("contextual.speech_acts").alias("i", "a")).where("a.resolved_proposition is not null")
    a = acts.select(F.concat("raw_id", F.lit("::v41::p"), F.col("i") + 1).alias("proposition_id"), "raw_id",
                    F.col("a.act").alias("speech_act"), *[F.col(f"a.resolved_proposition.{x}").cast("string").alias(x) for x in FACT],
                    _fact_text(F.col("a.resolved_proposition")).alias("retrieval_text"),
                    F.col("a.resolved_proposition.source_raw_ids").alias("source_raw_ids"))
    flat = sidecar.select("raw_id", F.posexplode("contextual.assertions").alias("i", "f"))
    b = flat.select(F.concat("raw_id", F.lit("::ctx::p"), F.col("i") + 1).alias("proposition_id"), "raw_id",
                    F.lit(None).cast("string").alias("speech_act"), *[F.col(f"f.{x}").cast("string").alias(x) for x in FACT],
                    _fact_text(F.col("f")).alias("retrieval_text"), F.lit(None).cast("array<string>").alias("source_raw_ids"))
    return a.unionByName(b).withColumn("conversation_id", F.substring_index("raw_id", "::", 1))


def edges(sidecar: DataFrame) -> DataFrame:
    """Typed edges; self-edges go, duplicates go on all five columns."""
    nul = lambda ty: F.lit(None).cast(ty)
    acts = sidecar.select("raw_id", F.posexplode("contextual.speech_acts").alias("i", "a"))
    typed = acts.where("a.resolved_proposition is not null").select(
        "raw_id", F.explode("a.resolved_proposition.source_raw_ids").alias("target_raw_id"), F.col("a.act").alias("edge_type"),
        F.concat("raw_id", F.lit("::v41::p"), F.col("i") + 1).alias("proposition_id"), nul("int").alias("occurrence_index"))
    ante = acts.select("raw_id", F.explode("a.antecedent_raw_ids").alias("target_raw_id"), F.lit("ANTECEDENT").alias("edge_type"),
                       nul("string").alias("proposition_id"), nul("int").alias("occurrence_index"))
    occ = sidecar.select("raw_id", F.posexplode("contextual.occurrence_links").alias("i", "l")).select(
        "raw_id", F.explode("l.antecedent_raw_ids").alias("target_raw_id"), F.lit("OCCURRENCE").alias("edge_type"),
        nul("string").alias("proposition_id"), (F.col("i") + 1).alias("occurrence_index"))
    flat = sidecar.where(F.coalesce(F.size("contextual.speech_acts"), F.lit(0)) <= 0).select(
        "raw_id", F.explode("contextual.antecedent_raw_ids").alias("target_raw_id"), F.lit("ANTECEDENT").alias("edge_type"),
        nul("string").alias("proposition_id"), nul("int").alias("occurrence_index"))
    all_edges = typed.unionByName(ante).unionByName(occ).unionByName(flat).withColumnRenamed("raw_id", "source_raw_id")
    return all_edges.where("source_raw_id <> target_raw_id").dropDuplicates()


def postings(facts: DataFrame) -> DataFrame:
    """Entities named by the facts: subject and value of parsed acts, subject of base facts."""
    both = F.array(F.struct(F.col("subject").alias("entity"), F.lit("SUBJECT").alias("role")),
                   F.struct(F.when(F.col("kind") == 0, F.col("value")).alias("entity"), F.lit("VALUE").alias("role")))
    return facts.where(F.col("kind") != 1).select("raw_id", "conversation_id", "assertion_id", F.explode(both).alias("p")).select(
        F.col("p.entity").alias("entity"), "raw_id", "conversation_id", "assertion_id", F.col("p.role").alias("role")).where(
        F.coalesce("entity", F.lit("")) != "")


def raw_views(sidecar: DataFrame, turns: DataFrame, deduplicated: bool = False) -> DataFrame:
    """Sidecar joined to its turn; retrieval_text = speaker, time, text and all derived parts in order."""
    c = F.col("contextual")
    acts = F.flatten(F.transform(F.coalesce(c["speech_acts"], F.array()), lambda a: F.array(
        F.coalesce(a["center_quote"], F.lit("")), F.when(a["assertion"].isNotNull(), _fact_text(a["assertion"])),
        F.when(a["resolved_proposition"].isNotNull(), _fact_text(a["resolved_proposition"])))))
    links = F.transform(F.coalesce(c["occurrence_links"], F.array()), lambda x: F.concat_ws(
        " ", *[F.coalesce(x[k], F.lit("")) for k in ("owner", "event", "relation")]))
    head = F.when(c.isNotNull(), F.array(F.coalesce(c["center_summary"], F.lit("")))).otherwise(F.array().cast("array<string>"))
    known = F.transform(F.concat(
        F.filter(F.transform(F.coalesce(c["speech_acts"], F.array()), lambda a: a["assertion"]), lambda a: a.isNotNull()),
        F.coalesce(c["assertions"], F.array())), lambda f: _sig(f, "relation"))
    base = F.coalesce(F.col("base_l2_direct"), F.array())
    sigs = F.transform(base, lambda b: _sig(b, "surface_relation"))
    fresh = F.when(c.isNull(), base).otherwise(F.filter(base, lambda b, i: ~F.array_contains(known, _sig(b, "surface_relation"))
                                                        & (F.array_position(sigs, _sig(b, "surface_relation")) == i + 1)))
    parts = F.concat(head, F.array_compact(acts), links, F.transform(fresh, lambda b: _base_text(b, deduplicated)))
    j = sidecar.join(turns.select("raw_id", "conversation_id", "session_id", "speaker", "timestamp", "text"), "raw_id")
    return j.select("raw_id", "conversation_id", F.col("session_id").alias("source_session_id"), "speaker", "timestamp",
                    F.col("text").alias("raw_text"), F.array_join(F.concat(F.array("speaker", "timestamp", "text"), parts), " ").alias("retrieval_text"),
                    "sidecar_status")


def merge_sidecar(manifest: DataFrame, base: DataFrame, parsed: Sequence[DataFrame]) -> DataFrame:
    """Priority merge: reused base, validated context, or uncertain fallback; later parse wins."""
    own = ("SELF_CONTAINED_REUSED", "SELF_CONTAINED_RAW", "SELF_CONTAINED_LLM")
    ranked = None
    for i, p in enumerate(parsed):
        p = p.select("raw_id", F.col("status").alias("parse_status"), "contextual", F.lit(i).alias("_p"))
        ranked = p if ranked is None else ranked.unionByName(p)
    last = ranked.groupBy("raw_id").agg(F.max_by(F.struct("parse_status", "contextual"), "_p").alias("x")).select("raw_id", "x.*")
    j = manifest.join(base, "raw_id", "left").join(last, "raw_id", "left")
    valid = F.coalesce(F.col("parse_status") == "VALIDATED", F.lit(False))
    reused = F.col("status").isin(*own) & ~valid
    return j.select("raw_id", F.when(reused, "BASE_REUSED").when(valid, "V41_VALIDATED").otherwise("V41_UNCERTAIN_FALLBACK").alias("sidecar_status"),
                    F.col("status").alias("manifest_status"), F.when(valid & ~reused, F.col("contextual")).alias("contextual"), "base_l2_direct")


# -- stores ----------------------------------------------------------------

def turn_entries(turns: DataFrame) -> DataFrame:
    who, body = tx.nonblank("speaker"), tx.strip(tx.text_of("text"))
    return turns.select(F.concat(F.lit("turn:"), "raw_id").alias("entry_id"), "conversation_id",
                        F.coalesce(F.concat(who, F.lit(": "), body), body).alias("content"),
                        F.col("timestamp").alias("created_at"), F.col("turn_id").alias("source_id"),
                        "session_id", "pos", F.lit("turn").alias("memory_bucket"))


def session_entries(turns: DataFrame) -> DataFrame:
    """One row per session: size, span, first time. Its turn ids are `turns` itself, keyed by session."""
    return turns.groupBy("conversation_id", "session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min_by("turn_id", "pos").alias("first_turn_id"), F.max_by("turn_id", "pos").alias("last_turn_id"),
        F.min_by("timestamp", "pos").alias("session_date"))


def time_buckets(turns: DataFrame, chunk: int = 20) -> DataFrame:
    """Turns labelled by day, else by session, else by fixed chunk; plus the bucket's first time."""
    sid = tx.nonblank("session_id")
    label = F.coalesce(tx.date_key("timestamp"), F.concat(F.lit("session_"), sid),
                       F.concat(F.lit("chunk_"), F.lpad(F.floor(F.col("pos") / chunk).cast("string"), 4, "0")))
    rows = turns.withColumn("bucket", label)
    ts = tx.nonblank("timestamp")
    head = rows.groupBy("conversation_id", "bucket").agg(
        F.count(F.lit(1)).alias("n_turns"), F.min("pos").alias("first_pos"),
        F.min_by(ts, F.when(ts.isNotNull(), F.col("pos"))).alias("bucket_time"))
    return rows, head


def turn_pairs(bucketed: DataFrame, keys: Sequence[str] = ("conversation_id", "bucket")) -> DataFrame:
    """Consecutive turns two by two inside a bucket."""
    rn = ordinal(bucketed, keys, ["pos"], F.floor(F.col("pos") / BLOCK))
    g = rn.withColumn("pair", F.floor((F.col("rn") - 1) / 2))
    line = F.struct("pos", F.concat_ws(": ", "speaker", "text").alias("line"), "turn_id")
    return g.groupBy(*keys, "pair").agg(F.array_sort(F.collect_list(line)).alias("t")).select(
        *keys, "pair", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("content"),
        F.transform("t", lambda x: x["turn_id"]).alias("source_ids"))


def passages(turns: DataFrame, n: int = 8) -> DataFrame:
    """Fixed groups of n turns, each line with its source header."""
    g = turns.withColumn("passage", F.floor(F.col("pos") / n))
    line = F.concat(F.lit("["), F.concat_ws(" | ", "turn_id", "session_id", "timestamp"), F.lit("] "), "speaker", F.lit(": "), "text")
    return g.groupBy("conversation_id", "passage").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l"), "turn_id"))).alias("t")).select(
        "conversation_id", "passage", F.array_join(F.transform("t", lambda x: x["l"]), "\n").alias("content"),
        F.transform("t", lambda x: x["turn_id"]).alias("source_ids"))


def bucket_store(pairs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Two levels per bucket: the summary first, then its pair entries."""
    s = summaries.select("conversation_id", "bucket", F.concat_ws("::", "conversation_id", "bucket", F.lit("summary")).alias("entry_id"),
                         F.col("summary").alias("content"), F.lit("summary").alias("level"), F.lit(0).cast("bigint").alias("level_order"))
    p = pairs.select("conversation_id", "bucket", F.concat_ws("::", "conversation_id", "bucket", F.concat(F.lit("pair"), F.col("pair"))).alias("entry_id"),
                     "content", F.lit("pair").alias("level"), (F.col("pair") + 1).cast("bigint").alias("level_order"))
    return s.unionByName(p)


def gist(page: Column | str) -> Column:
    """First three non-blank lines, at most 420 characters."""
    lines = F.filter(F.transform(F.split(tx.text_of(page), r"\r\n|\n|\r"), tx.strip), lambda x: x != "")
    head = tx.strip(F.array_join(F.slice(lines, 1, 3), " "))
    return F.when(head != "", F.substring(head, 1, 420)).otherwise(F.substring(tx.text_of(page), 1, 220))


def gist_store(pages: DataFrame) -> DataFrame:
    """A gist entry and a raw entry per page, sharing the page id."""
    both = F.array(F.struct(F.lit("gist").alias("level"), gist("content").alias("content")),
                   F.struct(F.lit("page").alias("level"), F.col("content").alias("content")))
    return pages.select("conversation_id", "page", F.explode(both).alias("e")).select(
        "conversation_id", "page", "e.level", "e.content", F.concat_ws("::", "conversation_id", F.concat(F.lit("page"), F.col("page")), F.col("e.level")).alias("entry_id"))


def core_archive(blocks: DataFrame, archive: DataFrame) -> DataFrame:
    b = blocks.select("conversation_id", "entry_id", "content", F.lit("core").alias("memory_bucket"))
    a = archive.select("conversation_id", "entry_id", "content", F.lit("archive").alias("memory_bucket"))
    return b.unionByName(a)


def perspective_batches(turns: DataFrame, n: int = 10) -> DataFrame:
    """Each speaker's view of a session (own turns = user, others = assistant) in batches of n.

    The batch number follows the position in the session, so batches are plain groups
    of at most n rows.
    """
    speakers = turns.select("conversation_id", F.col("speaker").alias("perspective")).distinct()
    v = turns.join(speakers, "conversation_id")
    role = F.when(F.col("speaker") == F.col("perspective"), "user").otherwise("assistant")
    line = F.struct("pos", F.concat(role, F.lit(": "), "text").alias("line"), "turn_id", "timestamp")
    g = v.withColumn("batch", F.floor((F.col("idx") - 1) / n)).groupBy("conversation_id", "session_id", "perspective", "batch")
    return g.agg(F.array_sort(F.collect_list(line)).alias("t")).select(
        "conversation_id", "session_id", "perspective", "batch", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("messages"),
        F.array_join(F.transform("t", lambda x: x["turn_id"]), ",").alias("turn_ids"), F.element_at("t", 1)["timestamp"].alias("first_timestamp"))


def self_contained(requests: DataFrame) -> DataFrame:
    """The whole text kept as one unit without assertions."""
    return requests.select(F.col("raw_id").alias("center_raw_id"), F.lit("c1").alias("clause_id"), F.lit("c1::unit::1").alias("unit_id"),
                           tx.text_of("text").alias("span"), F.lit("NON_PROPOSITIONAL").alias("status"),
                           F.lit("SESSION_SELF_CONTAINED_RAW").alias("reason"), F.lit(0).cast("bigint").alias("n_assertions"))


def request_view(requests: DataFrame) -> DataFrame:
    """Compact request: the duplicated text goes, clauses (or one whole-text clause) and context stay."""
    one = F.array(F.struct(F.lit("c1").alias("clause_id"), tx.text_of("center.text").alias("text")))
    clauses = F.when(F.size("center.clauses") > 0, F.col("center.clauses")).otherwise(one)
    return requests.select(F.struct("center.raw_id", "center.speaker", "center.timestamp", "center.source_session_id",
                                    "center.has_answer", clauses.alias("clauses")).alias("center"),
                           F.coalesce("context_only", F.array().cast(requests.schema["context_only"].dataType)).alias("context_only"))


# -- layered views ---------------------------------------------------------

def key_part(c) -> Column:
    """Key text of a value: blank, 0 and false all read UNKNOWN."""
    s = tx.text_of(c)
    return F.lower(tx.strip(F.when(s.isin("", "0", "0.0", "false", "False"), "UNKNOWN").otherwise(s)))


def key_text(*cols) -> Column:
    return F.concat_ws("|", *[key_part(c) for c in cols])


def entity_view(facts: DataFrame) -> DataFrame:
    """(entity, relation) → assertion and raw counts; members stay rows of `entity_members`."""
    return entity_members(facts).groupBy("entity", "relation").agg(
        F.count(F.lit(1)).alias("n_assertions"), F.countDistinct("raw_id").alias("n_raws"),
        F.min("assertion_id").alias("first_assertion"))


def entity_members(facts: DataFrame) -> DataFrame:
    names = F.array_distinct(F.filter(F.concat(F.array("subject"), F.map_values("roles")), lambda x: F.coalesce(x, F.lit("")) != ""))
    return facts.select("assertion_id", "raw_id", "relation", F.explode(names).alias("entity"))


def occurrence_view(facts: DataFrame) -> DataFrame:
    """Per occurrence: counts and the distinct participants, times, places and modalities."""
    o = facts.where(F.coalesce("occurrence_id", F.lit("")) != "").withColumn("occurrence", F.concat_ws("::", "raw_id", "occurrence_id"))
    people = F.filter(F.array(*[F.col("roles").getItem(r) for r in ("participant", "agent", "observer", "evaluated_subject")]),
                      lambda x: F.coalesce(x, F.lit("")) != "")
    vals = F.array(F.struct(F.lit("participant").alias("k"), people.alias("v")), F.struct(F.lit("time").alias("k"), F.array("time").alias("v")),
                   F.struct(F.lit("location").alias("k"), F.array("location").alias("v")), F.struct(F.lit("modality").alias("k"), F.array("modality").alias("v")))
    return o.select("occurrence", "assertion_id", F.explode(vals).alias("x")).select(
        "occurrence", "assertion_id", F.col("x.k").alias("facet"), F.explode_outer("x.v").alias("member")).where(
        F.coalesce("member", F.lit("")) != "").groupBy("occurrence", "facet", "member").agg(F.count(F.lit(1)).alias("n"))


def collection_view(facts: DataFrame) -> DataFrame:
    """subject|relation|type → its members with assertion, raw and occurrence counts."""
    return facts.groupBy(key_text("subject", "relation", "value_type").alias("collection_key"), key_text("value", "occurrence_id").alias("member")).agg(
        F.count(F.lit(1)).alias("n_assertions"), F.countDistinct("raw_id").alias("n_raws"),
        F.countDistinct(F.when(F.coalesce("occurrence_id", F.lit("")) != "", F.concat_ws("::", "raw_id", "occurrence_id"))).alias("n_occurrences"))


def collection_members(facts: DataFrame) -> DataFrame:
    """The assertions behind each member of `collection_view`, as rows; a collection is open for more (frontier OPEN)."""
    return facts.select(key_text("subject", "relation", "value_type").alias("collection_key"), key_text("value", "occurrence_id").alias("member"), "assertion_id", "raw_id",
                        _occurrence_of(), F.lit("OPEN").alias("frontier_status"))


def _occurrence_of() -> Column:
    return F.when(F.coalesce("occurrence_id", F.lit("")) != "", F.concat_ws("::", "raw_id", "occurrence_id")).alias("occurrence")


def competition_view(facts: DataFrame) -> DataFrame:
    """subject|relation|occurrence keys with more than one alternative value, with its modalities and polarities."""
    told = lambda c: F.array_sort(F.collect_set(c))        # a closed vocabulary
    alt = facts.groupBy(key_text("subject", "relation", "occurrence_id").alias("competition_key"), key_text("value").alias("alternative")).agg(
        F.count(F.lit(1)).alias("n_assertions"), F.countDistinct("raw_id").alias("n_raws"), told("modality").alias("modalities"), told("polarity").alias("polarities"))
    many = alt.groupBy("competition_key").agg(F.count(F.lit(1)).alias("n_alternatives")).where("n_alternatives > 1")
    return alt.join(many, "competition_key")


def competition_members(facts: DataFrame) -> DataFrame:
    """The assertions behind each alternative of `competition_view`, as rows."""
    m = facts.select(key_text("subject", "relation", "occurrence_id").alias("competition_key"), key_text("value").alias("alternative"), "assertion_id", "raw_id")
    return m.join(competition_view(facts).select("competition_key").distinct(), "competition_key", "left_semi")


def timeline_view(facts: DataFrame) -> DataFrame:
    return facts.where(F.coalesce("time", F.lit("")) != "").select(
        key_text("subject", "relation").alias("timeline_key"), "assertion_id", "raw_id", _occurrence_of(),
        F.col("time").alias("time_expression"), "time_owner", F.lit("UNORDERED").alias("ordering_status"))


def supersede(facts: DataFrame, order: Sequence[str] = ("timestamp", "session_id", "raw_id", "ord"),
              block: Column | None = None) -> DataFrame:
    """Mark a fact SUPERSEDED when the next fact of its (conversation, subject, relation) differs in value.

    Timestamps are compared as text. The successor is found by position through an
    equi-join, so a key with very many facts is spread over all tasks; `block` must be
    monotone in `order`.
    """
    keyed = facts.withColumn("_s", F.lower(tx.text_of("subject"))).withColumn("_r", F.lower(tx.text_of("relation")))
    blk = block if block is not None else F.coalesce(F.col(order[0]).cast("string"), F.lit(""))
    keys = ["conversation_id", "_s", "_r"]
    n = ordinal(keyed, keys, list(order), blk, "_rn")
    nxt = n.select(*keys, (F.col("_rn") - 1).alias("_rn"), F.col("value").alias("_nv"), F.col("assertion_id").alias("_na"))
    j = n.join(nxt, [*keys, "_rn"], "left")
    gone = F.col("_na").isNotNull() & ~F.col("_nv").eqNullSafe(F.col("value"))
    return j.withColumn("status", F.when(gone, "SUPERSEDED").otherwise("CURRENT")).withColumn(
        "superseded_by", F.when(gone, F.col("_na"))).drop("_s", "_r", "_rn", "_nv", "_na")


# -- evidence interface ----------------------------------------------------

OPENERS = (r"^(yes|yeah|yep|no|nope|sure|thanks|thank you|exactly|definitely|absolutely|that|this|it|they|he|she|sounds|"
           r"wow|great|nice|sorry)\b")
RESPONSE_ACTS = ["CONFIRMATION", "DENIAL", "ANSWER", "CORRECTION", "REACTION"]
STRONG_ACTS = RESPONSE_ACTS[:4]
SOCIAL_ACTS = ["NON_PROPOSITIONAL", "REACTION", "QUESTION", "REQUEST"]


def evidence_interface(raws: DataFrame, facts: DataFrame, graph: DataFrame, acts: DataFrame) -> DataFrame:
    """One row per raw: bindings, acts, links to earlier turns and carrier / response flags.

    raws: raw_id, conversation_id, session_id, idx, speaker, raw_text, retrieval_text, sidecar_status
    facts: raw_id, subject, relation, value, event, time; acts: raw_id, act, resolved
    """
    low = lambda c: F.lower(tx.normalize_text(c))
    sig = facts.select("raw_id", low("subject").alias("s"), low("relation").alias("r"),
                       low(F.coalesce("value", F.nullif("event", F.lit("")), F.col("time"))).alias("v"),
                       low("event").alias("e"), low("time").alias("t")).where("concat(s,r,v,e,t) <> ''").distinct()
    terms = F.array_distinct(F.flatten(F.collect_set(tx.tokens(F.concat_ws(" ", "s", "r", "v", "e")))))
    bind = sig.groupBy("raw_id").agg(F.count(F.lit(1)).alias("n_bindings"), terms.alias("terms"),
                                     F.countDistinct(F.nullif("v", F.lit(""))).alias("n_values"),
                                     F.countDistinct(F.nullif("t", F.lit(""))).alias("n_times"))
    name = F.upper(F.coalesce(F.nullif("act", F.lit("")), F.lit("UNKNOWN")))
    act = acts.groupBy("raw_id").agg(F.array_sort(F.collect_set(name)).alias("acts"), F.max(F.coalesce("resolved", F.lit(False))).alias("resolved"))
    links = graph.where(F.col("edge_type").isin("ANTECEDENT", "OCCURRENCE"))
    out = links.groupBy(F.col("source_raw_id").alias("raw_id")).agg(F.countDistinct("target_raw_id").alias("n_antecedents"))
    inc = links.select(F.col("target_raw_id").alias("raw_id")).distinct().withColumn("is_antecedent", F.lit(True))
    p = previous(raws, ["conversation_id", "session_id"], "idx", ["raw_id", "raw_text", "speaker", "retrieval_text"])
    j = p.join(bind, "raw_id", "left").join(act, "raw_id", "left").join(out, "raw_id", "left").join(inc, "raw_id", "left")
    none = F.array().cast("array<string>")
    acts_, terms_ = F.coalesce("acts", none), F.coalesce("terms", none)
    prior = low("prev_raw_text")
    marker = low("raw_text").rlike(OPENERS)
    answers = prior.endswith("?") & ~F.col("prev_speaker").eqNullSafe(F.col("speaker"))
    shared = F.size(F.array_intersect(terms_, tx.token_set(low("prev_retrieval_text")))) >= 2
    linkable = (F.col("sidecar_status") == "BASE_REUSED") & F.col("prev_raw_id").isNotNull()
    reason = F.when(linkable, F.when(answers, "ANSWER_TO_QUESTION").when(marker, "DISCOURSE_RESPONSE").when(shared, "SHARED_EVENT_TERMS"))
    response = F.arrays_overlap(acts_, F.array(*map(F.lit, RESPONSE_ACTS)))
    carrier = F.coalesce(F.col("n_bindings") > 0, F.lit(False)) | response
    return j.select(
        "raw_id", "conversation_id", F.coalesce("n_bindings", F.lit(0)).cast("bigint").alias("n_bindings"),
        F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"), F.coalesce("n_times", F.lit(0)).cast("bigint").alias("n_times"),
        F.array_join(acts_, ",").alias("speech_acts"), F.coalesce("n_antecedents", F.lit(0)).cast("bigint").alias("n_antecedents"),
        F.when(reason.isNotNull(), F.col("prev_raw_id")).alias("linked_raw_id"), reason.alias("link_reason"),
        F.coalesce("is_antecedent", F.lit(False)).alias("is_antecedent"), response.alias("is_response"),
        (F.arrays_overlap(acts_, F.array(*map(F.lit, STRONG_ACTS))) | F.coalesce("resolved", F.lit(False))).alias("is_strong_response"),
        carrier.alias("is_carrier"), (~carrier & (F.size(acts_) > 0) & (F.size(F.array_except(acts_, F.array(*map(F.lit, SOCIAL_ACTS)))) == 0)).alias("social_only"))


# -- chunk results ---------------------------------------------------------

def merge_chunks(facts: DataFrame, units: DataFrame):
    """Renumber assertion ids across the chunks of a raw and remap the unit links.

    facts: raw_id, chunk, pos, assertion_id; units: raw_id, chunk, unit_id, assertion_ids
    """
    numbered = ordinal(facts, ["raw_id"], ["chunk", "pos"], F.col("chunk"), "_n").withColumn("new_id", F.concat(F.lit("a"), F.col("_n"))).drop("_n")
    ids = numbered.select("raw_id", "chunk", F.col("assertion_id").alias("old"), "new_id")
    link = units.select("raw_id", "chunk", "unit_id", F.posexplode_outer("assertion_ids").alias("p", "old"))
    mapped = link.join(ids, ["raw_id", "chunk", "old"], "left").withColumn("id", F.coalesce("new_id", "old"))
    out = mapped.groupBy("raw_id", "chunk", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("id").isNotNull(), F.struct("p", "id")))), lambda x: x["id"]), ",").alias("assertion_ids"))
    return numbered, out


def recover_links(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Unit of an unlinked fact: the only asserted unit of its only clause, else the best unique overlap.

    facts: raw_id, assertion_id, clause_ids, text; units: raw_id, clause_id, unit_id, span, status
    Groups are the units of one response, which its schema bounds.
    """
    asserted = units.where(F.col("status") == "ASSERTED")
    known = units.select("raw_id", "clause_id").distinct()
    cited = facts.select("raw_id", "assertion_id", F.explode_outer("clause_ids").alias("clause_id")).join(known, ["raw_id", "clause_id"])
    single = cited.groupBy("raw_id", "assertion_id").agg(F.count(F.lit(1)).alias("n"), F.first("clause_id").alias("clause_id")).where("n = 1").drop("n")
    cand = single.join(asserted, ["raw_id", "clause_id"]).groupBy("raw_id", "assertion_id").agg(
        F.count(F.lit(1)).alias("n_cand"), F.min("unit_id").alias("only_unit"))
    words = lambda c: F.array_distinct(F.filter(tx.find_all(F.lower(tx.text_of(c)), r"(?U)[\w'-]+"), lambda x: F.length(x) >= 4))
    open_ = facts.join(cand, ["raw_id", "assertion_id"], "left").withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
    toks = open_.where("n_cand = 0").select("raw_id", "assertion_id", F.explode(words("text")).alias("w"))
    utoks = asserted.select("raw_id", "unit_id", F.size(words("span")).alias("m"), F.explode(words("span")).alias("w"))
    hit = toks.join(utoks, ["raw_id", "w"]).groupBy("raw_id", "assertion_id", "unit_id", "m").agg(F.count(F.lit(1)).alias("o"))
    s = hit.withColumn("score", F.col("o") / F.col("m"))
    w = W.partitionBy("raw_id", "assertion_id").orderBy(F.desc("score"), F.desc("o"), F.desc("unit_id"))
    best = s.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("raw_id", "assertion_id").agg(
        F.max_by(F.struct("score", "o", "unit_id"), -F.col("rn")).alias("b"), F.max(F.when(F.col("rn") == 2, F.struct("score", "o"))).alias("z"))
    ok = best.where((F.col("b.score") >= 0.5) & (F.col("z").isNull() | (F.struct("b.score", "b.o") > F.col("z")))).select(
        "raw_id", "assertion_id", F.col("b.unit_id").alias("lex_unit"))
    j = open_.join(ok, ["raw_id", "assertion_id"], "left")
    unit = F.when(F.col("n_cand") == 1, F.col("only_unit")).otherwise(F.col("lex_unit"))
    return j.select("raw_id", "assertion_id", unit.alias("unit_id"),
                    F.when(F.col("n_cand") == 1, "recovered_unit_link_from_single_asserted_clause")
                    .when(F.col("lex_unit").isNotNull(), "recovered_unit_link_by_unique_lexical_overlap").alias("repair"))
