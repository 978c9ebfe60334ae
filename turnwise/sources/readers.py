"""Readers: files with declared schemas, and decoders of nested dataset records.

Every reader ends in a decoder that takes a frame with the record's JSON text in `value`,
so the same code serves files, tables and streams.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators.scale import fits_broadcast

TURN = "struct<speaker:string,dia_id:string,text:string,blip_caption:string,timestamp:string>"
QA = "array<struct<question:string,answer:string,category:string,evidence:array<string>>>"
WRAPPERS = ("samples", "records", "data", "items")


def read_text_records(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """One JSON text per row: a line each, or a whole file each; a leading byte-order mark goes."""
    rows = spark.read.text(path, wholetext=whole_file)
    return rows.select(F.regexp_replace("value", "^﻿", "").alias("value")).where(tx.strip(F.col("value")) != "")


def decode_records(rows: DataFrame) -> DataFrame:
    """One row per record from lines, arrays, or an object holding the array under a known key."""
    v = F.col("value")
    shape = F.substring(F.ltrim(v), 1, 1)
    wrapped = F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in WRAPPERS])
    array_text = F.when(shape == "[", v).when(F.startswith(wrapped, F.lit("[")), wrapped)
    items = F.when(array_text.isNotNull(), F.transform(
        F.from_json(array_text, "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array(v))
    return rows.select(F.explode(items).alias("value"))


def read_records(spark: SparkSession, path: str, schema: str | None = None, whole_file: bool = False) -> DataFrame:
    """JSONL, JSON array or wrapped array; typed when a schema is given.

    `whole_file` reads each file as one value, which is for small files; `json_array.read_array` splits large arrays.
    """
    rows = decode_records(read_text_records(spark, path, whole_file))
    return rows if schema is None else rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_journal(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot of a file still being appended to: whole rows, and the half-written lines."""
    return split_journal(spark.read.text(path), schema)


def split_journal(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = rows.where(tx.strip(F.col("value")) != "").withColumn("v", F.try_parse_json("value"))
    good = parsed.where("v is not null").select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, parsed.where("v is null").select("value")


# -- nested datasets -------------------------------------------------------

def load_sessions_qa(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of records whose conversation maps session_N to turn lists.

    Sessions are ordered by number, an image caption precedes the text, a missing id is
    built from the session and place; questions explode to `{conv}__qa_{i}`.
    """
    r = rows.select(F.get_json_object("value", "$.sample_id").alias("conversation_id"),
                    F.from_json(F.get_json_object("value", "$.conversation"), "map<string,variant>").alias("c"),
                    F.from_json(F.get_json_object("value", "$.qa"), QA).alias("qa"))
    sess = r.select("conversation_id", "c", F.explode(F.map_entries("c")).alias("e")).where(F.col("e.key").rlike(r"^session_\d+$"))
    no = F.regexp_extract("e.key", r"(\d+)$", 1).cast("int")
    date = F.trim(F.to_json(F.try_element_at("c", F.concat(F.col("e.key"), F.lit("_date_time")))), F.lit('"'))
    t = sess.select("conversation_id", no.alias("session_no"), F.col("e.key").alias("session_id"), date.alias("timestamp"),
                    F.posexplode(F.from_json(F.to_json("e.value"), f"array<{TURN}>")).alias("i", "t"))
    cap = tx.nonblank(F.col("t.blip_caption"))
    text = F.concat(F.coalesce(F.concat(F.lit("[Image: "), cap, F.lit("] ")), F.lit("")), tx.normalize_text(F.col("t.text")))
    turn_id = F.coalesce(tx.nonblank(F.col("t.dia_id")), F.concat(F.lit("D"), F.col("session_no"), F.lit(":"), F.col("i") + 1))
    turns = t.select("conversation_id", "session_no", "session_id", "timestamp", (F.col("i") + 1).alias("idx"), turn_id.alias("turn_id"),
                     F.coalesce(F.col("t.speaker"), F.lit("")).alias("speaker"), tx.strip(text).alias("text"))
    qa = r.select("conversation_id", F.posexplode("qa").alias("i", "q"))
    samples = qa.select(F.concat("conversation_id", F.lit("__qa_"), F.col("i")).alias("sample_id"), "conversation_id", F.col("q.question").alias("question"),
                        F.col("q.answer").alias("answer"), F.col("q.category").alias("category"), F.col("q.evidence").alias("evidence"))
    return turns, samples


def evidence_texts(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """Evidence ids of the questions with the text of the turn they name (null where none)."""
    e = samples.select("sample_id", "conversation_id", F.posexplode("evidence").alias("o", "turn_id"))
    return e.join(turns.select("conversation_id", "turn_id", F.col("text").alias("evidence_text")), ["conversation_id", "turn_id"], "left")


def observation_index(rows: DataFrame) -> DataFrame:
    """(turn_id, fact) pairs of map<session, map<speaker, [fact, id | ids]>>."""
    o = F.from_json(F.get_json_object("value", "$.observation"), "map<string,map<string,array<array<variant>>>>")
    r = rows.select(F.get_json_object("value", "$.sample_id").alias("conversation_id"), F.explode(F.map_values(o)).alias("m"))
    f = r.select("conversation_id", F.explode(F.flatten(F.map_values("m"))).alias("p")).where(F.size("p") >= 2)
    ref = F.to_json(F.element_at("p", 2))
    ids = F.when(F.startswith(ref, F.lit("[")), F.from_json(ref, "array<string>")).otherwise(F.array(F.trim(ref, F.lit('"'))))
    fact = F.variant_get(F.element_at("p", 1), "$", "string")
    return f.select("conversation_id", F.explode(ids).alias("turn_id"), fact.alias("fact")).where(tx.strip(F.col("turn_id")) != "")


def _field(j, *names: str):
    """First of the named fields of a JSON object that is neither null nor blank, white space collapsed."""
    return F.coalesce(*[F.nullif(tx.normalize_text(F.get_json_object(j, f"$.{k}")), F.lit("")) for k in names])


def _items(j):
    """Members of a JSON array, or values of a JSON object, as JSON texts; else null."""
    listed = F.when(F.startswith(F.ltrim(j), F.lit("[")), F.transform(F.from_json(j, "array<variant>"), lambda x: F.to_json(x)))
    return F.coalesce(listed, F.when(F.startswith(F.ltrim(j), F.lit("{")), F.transform(F.map_values(F.from_json(j, "map<string,variant>")), lambda x: F.to_json(x))))


def _is(j, opening: str):
    return F.startswith(j, F.lit(opening))


def _unquoted(j):
    return F.from_json(F.concat(F.lit("["), j, F.lit("]")), "array<string>")[0]


def load_haystack(rows: DataFrame, granularity: str = "turn") -> DataFrame:
    """Turns (or whole sessions) of question records with parallel session, id and date lists.

    A session is a list of turns, an object holding a list or object of them, or a text; it is named by itself, by the id
    list, or by its place from 0. A turn is a text or an object; blank ones are dropped but keep their number.
    """
    g = lambda k: F.get_json_object("value", f"$.{k}")
    r = rows.select(F.coalesce(*[F.nullif(g(k), F.lit("")) for k in ("sample_id", "question_id", "id")]).alias("sample_id"), F.from_json(g("haystack_session_ids"), "array<string>").alias("ids"),
                    F.from_json(g("haystack_dates"), "array<string>").alias("dates"), F.from_json(g("haystack_sessions"), "array<variant>").alias("ss"))
    s = r.select("sample_id", "ids", "dates", F.posexplode("ss").alias("s_no", "s")).withColumn("s", F.to_json("s"))
    held = F.coalesce(*[F.when(F.get_json_object("s", f"$.{k}").rlike(r"^\s*[\[{]"), F.get_json_object("s", f"$.{k}")) for k in ("session", "turns", "messages", "history", "dialogue")])
    named = F.when(_is(F.col("s"), "{"), _field("s", "session_id", "id", "name"))
    listed = F.nullif(tx.normalize_text(F.try_element_at("ids", F.col("s_no") + 1)), F.lit(""))
    sid = F.coalesce(named, listed, F.concat(F.lit("session_"), "s_no"))
    body = F.when(_is(F.col("s"), "["), _items(F.col("s"))).when(_is(F.col("s"), "{"), _items(held))
    s = s.select("sample_id", sid.alias("session_id"), tx.normalize_text(F.try_element_at("dates", F.col("s_no") + 1)).alias("timestamp"), "s_no", "s", body.alias("body"))

    def turn(j):
        obj = _is(j, "{")
        return F.struct(F.when(obj, _field(j, "role", "speaker", "author")).alias("role"),
                        F.when(obj, _field(j, "content", "text", "message", "utterance")).when(_is(j, '"'), F.nullif(tx.normalize_text(_unquoted(j)), F.lit(""))).alias("text"),
                        F.coalesce(F.when(obj, F.get_json_object(j, "$.has_answer")) == "true", F.lit(False)).alias("has_answer"))

    if granularity == "turn":
        t = s.select("sample_id", "session_id", "timestamp", "s_no", F.posexplode("body").alias("i", "j")).withColumn("t", turn(F.col("j"))).where(F.col("t.text").isNotNull())
        return t.select("sample_id", "session_id", "timestamp", "s_no", F.col("i").alias("turn_index"), F.concat("session_id", F.lit(":turn_"), F.col("i")).alias("turn_id"),
                        F.concat("session_id", F.lit("_"), F.col("i") + 1).alias("official_turn_id"), F.coalesce("t.role", F.lit("unknown")).alias("speaker"), "t.text", "t.has_answer")
    said = F.filter(F.transform(F.coalesce("body", F.array().cast("array<string>")), turn), lambda x: x["text"].isNotNull())
    lines = F.when(_is(F.col("s"), '"'), F.array(tx.normalize_text(_unquoted(F.col("s"))))).otherwise(
        F.transform(said, lambda x: F.when(x["role"].isNotNull(), F.concat(x["role"], F.lit(": "), x["text"])).otherwise(x["text"])))
    return s.select("sample_id", "session_id", "timestamp", "s_no", F.array_join(lines, "\n").alias("text"), F.exists(said, lambda x: x["has_answer"]).alias("has_answer"),
                    F.size(lines).cast("bigint").alias("n_turns"))


def gold_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First non-empty id list among the given columns, blanks dropped."""
    clean = lambda c: F.filter(F.transform(F.col(c), tx.normalize_text), lambda x: x != "")
    firsts = [F.when(F.size(clean(k)) > 0, clean(k)) for k in keys]
    return df.withColumn("gold_ids", F.coalesce(*firsts, F.array().cast("array<string>")))


def gold_turns(turns: DataFrame) -> DataFrame:
    """User turns flagged as holding the answer."""
    return turns.where((tx.normalize_role("speaker") == "user") & F.col("has_answer")).select("sample_id", F.col("official_turn_id").alias("gold_turn_id"))


# Members of a record that are also kept as metadata.
METADATA_KEYS = ("conversation_id", "dialog_id", "session_group_id", "source_sample_id", "question_date", "answer_session_ids", "answer_turn_ids", "gold_memory_ids", "haystack_session_ids")


def _members(j):
    """map<key, JSON text> of a JSON object."""
    return F.transform_values(F.from_json(j, "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def _truthy(j):
    """The JSON text, or null where it is an empty or false value."""
    return F.when(~F.regexp_replace(j, r"\s", "").isin("[]", "{}", '""', "null", "false", "0"), j)


def _texts(j):
    """Members of a JSON array as texts, strings without their quotes."""
    return F.transform(_items(j), lambda x: F.when(_is(x, '"'), _unquoted(x)).otherwise(x))


def load_generic(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples and turns of loosely named records: aliases coalesced, history as list of objects, of strings, or a map.

    Turns are numbered through a record's whole history; a map names their sessions, which a turn may override. Samples
    also carry question_type, evidence units, required and forbidden fact ids, and as JSON the success criterion (by default
    the gold answer), the counterfactual, evidence quality and support, and the metadata by key. Turns carry timestamp and
    metadata. Facts and relations are tables of their own (`generic_facts`, `generic_relations`).
    """
    g = lambda *ks: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{k}"), F.lit("")) for k in ks])
    sid = F.coalesce(g("sample_id", "question_id", "id"), F.lit("")).alias("sample_id")
    answer = F.coalesce(F.get_json_object("value", "$.answer"), g("gold_answer", "reference_answer"), F.lit(""))
    m = _members(F.col("value"))
    evidence = F.coalesce(_truthy(m["key_evidence_units"]), _truthy(m["evidence"]))
    units = F.when(_is(evidence, '"'), F.array(_unquoted(evidence))).otherwise(_texts(evidence))
    ids = lambda k: F.coalesce(_texts(_truthy(m[k])), F.array().cast("array<string>"))
    obj_or = lambda k, other: F.when(_is(m[k], "{"), m[k]).otherwise(other)
    base = F.coalesce(_members(obj_or("metadata", F.lit(None).cast("string"))), F.create_map().cast("map<string,string>"))
    more = F.map_filter(m, lambda k, _: k.isin(*METADATA_KEYS))
    named_ = F.create_map(F.lit("question_id"), F.to_json(F.array(F.coalesce(g("question_id"), g("sample_id", "question_id", "id"), F.lit("")))))
    default = F.transform_values(named_, lambda _, v: F.substring(v, F.lit(2), F.length(v) - 2))
    add = lambda have, new: F.map_concat(have, F.map_filter(new, lambda k, _: ~F.map_contains_key(have, k)))
    with_id = F.element_at(F.transform(F.array(base), lambda h: add(h, default)), 1)
    metadata = F.element_at(F.transform(F.array(with_id), lambda h: add(h, more)), 1)
    gold = F.to_json(F.struct(answer.alias("gold_answer")))
    samples = rows.select(sid, F.coalesce(g("question", "query"), F.lit("")).alias("question"), answer.alias("answer"), tx.task_type(g("task_type", "question_type"), "generic").alias("task_type"),
                          F.coalesce(g("question_type", "task_type"), F.lit("generic")).alias("question_type"),
                          F.coalesce(F.filter(units, lambda u: tx.strip(u) != ""), F.array().cast("array<string>")).alias("key_evidence_units"),
                          g("key_evidence_quality").alias("key_evidence_quality"), g("key_evidence_support").alias("key_evidence_support"),
                          ids("required_fact_ids").alias("required_fact_ids"), ids("forbidden_fact_ids").alias("forbidden_fact_ids"),
                          obj_or("success_criterion", gold).alias("success_criterion"), F.nullif(m["counterfactual"], F.lit("null")).alias("counterfactual"), metadata.alias("metadata"))
    full = lambda k: F.when(~F.regexp_replace(F.get_json_object("value", f"$.{k}"), r"\s", "").isin("[]", "{}", '""', ""), F.get_json_object("value", f"$.{k}"))
    h = rows.select(sid, F.coalesce(*[full(k) for k in ("history", "conversation_history", "conversation")]).alias("h"))
    is_map = F.startswith(F.ltrim("h"), F.lit("{"))
    none = F.lit(None).cast("string")
    kept = lambda j: F.filter(_items(j), lambda x: _is(x, "{") | _is(x, '"'))
    named = F.flatten(F.transform(F.map_entries(F.from_json(F.when(is_map, F.col("h")), "map<string,variant>")), lambda e: F.transform(
        F.when(_is(F.to_json(e["value"]), "["), kept(F.to_json(e["value"]))).otherwise(F.array().cast("array<string>")), lambda x, i: F.struct(e["key"].alias("s"), i.alias("n"), x.alias("j")))))
    plain = F.transform(_items(F.when(~is_map, F.col("h"))), lambda x: F.struct(none.alias("s"), F.lit(None).cast("int").alias("n"), x.alias("j")))
    t = h.select("sample_id", F.posexplode(F.when(is_map, named).otherwise(plain)).alias("i", "e")).select("sample_id", "i", "e.s", "e.n", "e.j")
    obj = _is(F.col("j"), "{")
    f = lambda *ks: F.when(obj, F.coalesce(*[F.nullif(F.get_json_object("j", f"$.{k}"), F.lit("")) for k in ks]))
    turns = t.select("sample_id", F.coalesce(f("session_id"), "s", F.lit("")).alias("session_id"), F.coalesce(f("turn_index").cast("int"), "n", "i").alias("turn_index"),
                     F.coalesce(f("turn_id", "id"), F.concat(F.lit("turn_"), F.col("i") + 1)).alias("turn_id"), F.coalesce(f("speaker", "role"), F.lit("unknown")).alias("speaker"),
                     F.coalesce(f("text", "content"), F.when(~obj, _unquoted(F.col("j"))), F.lit("")).alias("text"),
                     F.when(obj, F.get_json_object("j", "$.timestamp")).alias("timestamp"), F.when(obj & _is(F.get_json_object("j", "$.metadata"), "{"), F.get_json_object("j", "$.metadata")).otherwise("{}").alias("turn_metadata"))
    return samples, turns


def _children(rows: DataFrame, key: str) -> DataFrame:
    """The objects in a record's list `key`: sample_id, n (place from 0), j."""
    g = lambda *ks: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{k}"), F.lit("")) for k in ks])
    listed = rows.select(F.coalesce(g("sample_id", "question_id", "id"), F.lit("")).alias("sample_id"), F.posexplode(_items(F.get_json_object("value", f"$.{key}"))).alias("n", "j"))
    return listed.where(_is(F.col("j"), "{"))


def generic_facts(rows: DataFrame) -> DataFrame:
    """Facts worth remembering, with the defaults of a fact that leaves fields out; its source as JSON."""
    f = lambda k, d: F.coalesce(F.nullif(F.get_json_object("j", f"$.{k}"), F.lit("")), F.lit(d)).alias(k)
    return _children(rows, "memory_worthy_facts").select(
        "sample_id", "n", f("fact_id", ""), f("subject", "unknown"), f("attribute", "unknown_attribute"), f("value", ""), F.get_json_object("j", "$.timestamp").alias("timestamp"),
        F.coalesce(F.get_json_object("j", "$.source"), F.lit("{}")).alias("source"), f("fact_type", "semantic"))


def generic_relations(rows: DataFrame) -> DataFrame:
    """Which fact supersedes which."""
    f = lambda k, d: F.coalesce(F.nullif(F.get_json_object("j", f"$.{k}"), F.lit("")), F.lit(d)).alias(k)
    return _children(rows, "supersede_relations").select(
        "sample_id", "n", f("old_fact_id", ""), f("new_fact_id", ""), f("attribute", "unknown_attribute"), F.get_json_object("j", "$.reason").alias("reason"))


def load_assets(documents: DataFrame, qa: DataFrame, facts: DataFrame, relations: DataFrame):
    """Samples and turns of the four-table layout; facts and relations stay child tables by parent.

    documents.history: array of structs that name some of turn_id or id, session_id, speaker or role, text or content,
    turn_index, timestamp, metadata (a struct or map, given as JSON); a turn without an id is named by its place from 1.
    """
    d = documents.select(F.col("doc_id").alias("parent_id"), F.posexplode("history").alias("i", "h"))
    fields = d.schema["h"].dataType.names
    f = lambda *ks: F.coalesce(*[F.nullif(tx.text_of(F.col(f"h.{k}")), F.lit("")) for k in ks if k in fields], F.lit(None).cast("string"))
    index = [F.col("h.turn_index")] if "turn_index" in fields else []
    turns = d.select("parent_id", F.coalesce(f("turn_id", "id"), F.concat(F.lit("turn_"), F.col("i") + 1)).alias("turn_id"), F.coalesce(f("session_id"), F.lit("")).alias("session_id"),
                     F.coalesce(f("speaker", "role"), F.lit("unknown")).alias("speaker"), F.coalesce(f("text", "content"), F.lit("")).alias("text"), F.coalesce(*index, F.col("i")).alias("turn_index"), f("timestamp").alias("timestamp"),
                     F.coalesce(F.to_json("h.metadata") if "metadata" in fields else F.lit(None).cast("string"), F.lit("{}")).alias("turn_metadata"))
    known = documents.select(F.col("doc_id").alias("parent_id"), F.size("history").alias("n_history"))
    nf = facts.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_facts"))
    nr = relations.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_relations"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    samples = qa.join(known, "parent_id", "left").join(nf, "parent_id", "left").join(nr, "parent_id", "left").select(
        *qa.columns, z("n_history"), z("n_facts"), z("n_relations"))
    return samples, turns, facts, relations


# -- requests and manifests ------------------------------------------------

def prepare(turns: DataFrame, granularity: str = "turn") -> DataFrame:
    """Request rows at turn, session or conversation granularity.

    At turn level the request carries its text as one clause. Coarser requests are rows of
    (request, clause): the clauses of a long conversation are never gathered into one value.
    """
    rid = {"turn": F.col("raw_id"), "session": F.concat_ws("::", "conversation_id", "session_id"),
           "conversation": F.concat("conversation_id", F.lit("::CONVERSATION"))}[granularity]
    clause = {"turn": F.lit("c1"), "session": F.concat(F.lit("c"), F.col("idx")),
              "conversation": F.concat(F.lit("s"), F.col("session_no"), F.lit("::c"), F.col("idx"))}[granularity]
    body = F.col("text") if granularity == "turn" else F.concat_ws(": ", "speaker", "text")
    return turns.where(tx.strip(tx.text_of("text")) != "").select(
        rid.alias("request_id"), "conversation_id", clause.alias("clause_id"), "pos", F.coalesce(tx.nonblank("timestamp"), F.lit("unknown")).alias("timestamp"), body.alias("text"))


def question_manifest(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Per question: how many turns of its sessions exist, are cached, rejected or missing.

    questions: sample_id, session_ids array; cache: session_id, raw_id, status
    """
    s = questions.select("sample_id", F.explode("session_ids").alias("session_id"))
    j = s.join(cache, "session_id", "left")
    return j.groupBy("sample_id").agg(F.countDistinct("session_id").alias("n_sessions"), F.count("raw_id").alias("total"),
                                      F.count_if(F.col("status") == "SUCCESS").alias("cached"), F.count_if(F.col("status") == "REJECTED").alias("rejected"),
                                      F.count_if(F.col("raw_id").isNotNull() & F.col("status").isNull()).alias("missing"))


def cache_manifest(requests: DataFrame, ok: DataFrame, rejected: DataFrame) -> DataFrame:
    """SUCCESS / REJECTED / MISSING per request by presence in the result sets."""
    a = ok.select("raw_id").distinct().withColumn("_ok", F.lit(True))
    b = rejected.select("raw_id").distinct().withColumn("_no", F.lit(True))
    return requests.join(a, "raw_id", "left").join(b, "raw_id", "left").withColumn(
        "status", F.when(F.col("_ok"), "SUCCESS").when(F.col("_no"), "REJECTED").otherwise("MISSING")).drop("_ok", "_no")


def decode_entries(rows: DataFrame) -> DataFrame:
    """Precomputed entries of one sample each (`sample_id`, `value`): default ids, first content field."""
    g = lambda *ks: F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{k}"), F.lit("")) for k in ks])
    return rows.select("sample_id", F.coalesce(g("entry_id", "id"), F.concat("sample_id", F.lit(":"), F.col("line_no"))).alias("entry_id"),
                       F.coalesce(g("content", "text", "memory"), F.lit("")).alias("content"),
                       F.from_json(g("source_ids"), "array<string>").alias("source_ids"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries from `<sample_id>.jsonl` files of a folder."""
    from pyspark.sql import Window as W
    rows = spark.read.text(path).withColumn("sample_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    order = F.row_number().over(W.partitionBy("sample_id").orderBy(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return decode_entries(rows.where(tx.strip(F.col("value")) != "").withColumn("line_no", order))


# -- filters ---------------------------------------------------------------

def expand_ids(spec: Sequence[str]) -> list[str]:
    """`conv-01-05` → conv-01 … conv-05, keeping the zero padding; other items stay."""
    import re
    out = []
    for item in spec:
        m = re.fullmatch(r"(.*?)(\d+)-(\d+)", item.strip())
        if m and int(m[2]) <= int(m[3]):
            out += [f"{m[1]}{i:0{len(m[2])}d}" for i in range(int(m[2]), int(m[3]) + 1)]
        elif item.strip():
            out.append(item.strip())
    return out


def filter_ids(df: DataFrame, column: str, spec: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows whose id is in the expanded list; the list is a frame of at most the given ids."""
    ids = df.sparkSession.createDataFrame([(i,) for i in expand_ids(spec)], f"{column} string")
    kept = df.join(F.broadcast(ids) if fits_broadcast(ids) else ids, column, "left_semi")
    return kept if limit is None else kept.orderBy(column).limit(limit)


def filter_category(df: DataFrame, column: str = "category", excluded: Sequence[str] = ("5",)) -> DataFrame:
    return df.where(~F.col(column).isin(list(excluded)))


def shard(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Deterministic share i of n by id hash: no order, no shuffle."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % n == i)


def index_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, start: int, count: int) -> DataFrame:
    """Rows at positions [start, start+count) of a stable order."""
    from ..operators.scale import ordinal
    n = ordinal(df, keys, order, block, "position")
    return n.where((F.col("position") > start) & (F.col("position") <= start + count))
