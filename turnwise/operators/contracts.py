"""Validation, repair and decision rules over tables of model responses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .rowset import overlay

# Closed vocabularies of the contracts.
RELATION_FAMILIES = ["IDENTITY_ATTRIBUTE", "POSSESSION", "PARTICIPATION", "CREATION", "LOCATION", "TIME", "PREFERENCE",
                     "EVALUATION", "STATE", "CAUSE_RESULT", "RELATIONSHIP", "COMMUNICATION", "COMPARISON",
                     "SET_MEMBERSHIP", "OTHER"]
ANSWER_TYPES = ["PERSON", "EVENT", "ACTIVITY", "OBJECT", "LOCATION", "TIME", "DURATION", "COUNT", "BOOLEAN", "STATE",
                "ATTITUDE", "REASON", "DESCRIPTION", "MEMBER_SET", "OTHER"]
ROLES = ["SUBJECT", "ANSWER_VALUE", "OBSERVER", "EVALUATED_SUBJECT", "AGENT", "PARTICIPANT", "EVENT", "TIME_OWNER",
         "LOCATION", "CAUSE", "RESULT", "LEFT_SIDE", "RIGHT_SIDE", "SET_MEMBER"]
EVIDENCE_SHAPES = ["SINGLE_ASSERTION", "SAME_EVENT_MULTI_RAW", "CROSS_EPISODE_SET", "TWO_SIDED_COMPARISON",
                   "CAUSE_RESULT_CHAIN", "TEMPORAL_SEQUENCE", "ATTITUDE_INFERENCE"]
MODALITIES = ["ACTUAL_COMPLETED", "CURRENT_STATE", "PLANNED", "PREDICTED", "HYPOTHETICAL", "UNKNOWN"]
QUERY_MODALITIES = ["ACTUAL_ONLY", "CURRENT_OR_ACTUAL", "PLANNED_ONLY", "PREDICTED_ONLY", "HYPOTHETICAL_ONLY", "ANY"]
POLARITIES = ["POSITIVE", "NEGATIVE", "CONTRASTED", "UNKNOWN"]
INFERENCES = ["DIRECT_ONLY", "PARAPHRASE", "ROLE_INVERSION", "EXPLICIT_CAUSAL", "EXPLICIT_ATTITUDE",
              "EXPLICIT_TEMPORAL_ORDER"]
QUERY_KINDS = ["SINGLE_FACT", "SET_COLLECTION", "TEMPORAL", "COMPARISON", "CAUSE_RESULT", "MULTIHOP"]
PLAN_KEYS = ["query_kind", "target_entities", "owner_roles", "relation_queries", "value_queries", "event_queries",
             "temporal_queries", "polarity", "modality", "required_evidence_acts", "graph_operations", "lexical_expansions"]
PLAN_LISTS = ["target_entities", "owner_roles", "relation_queries", "value_queries", "event_queries", "temporal_queries",
              "required_evidence_acts", "graph_operations", "lexical_expansions"]
PLAN_NONEMPTY = ["relation_queries", "value_queries", "required_evidence_acts", "graph_operations", "lexical_expansions"]
SPEECH_ACTS = ["ASSERTION", "CONFIRMATION", "DENIAL", "ANSWER", "CORRECTION", "QUESTION", "REACTION", "REQUEST",
               "NON_PROPOSITIONAL"]
NEEDS_ANTECEDENT = ["CONFIRMATION", "DENIAL", "ANSWER", "CORRECTION"]
DEPENDENCIES = ["NONE", "COREFERENCE", "ELLIPSIS", "CONFIRMATION", "DEICTIC", "OTHER"]
UNIT_STATUSES = ["ASSERTED", "NON_PROPOSITIONAL", "UNRESOLVED"]
MERGE_STATUSES = ["CURRENT", "HISTORICAL", "SUPERSEDED", "UNCERTAIN"]
BANNED_CATEGORIES = ["other", "others", "miscellaneous", "general", "unknown"]
PERMANENT_REPAIRS = ["generated_local_assertion_id", "normalized_assertion_ids", "normalized_answer_type",
                     "normalized_mention_provenance", "normalized_mentions", "normalized_roles",
                     "normalized_relation_family", "normalized_scope", "normalized_units_list",
                     "reconstructed_unit_from_assertion_provenance"]
HIGH_RISK_REPAIRS = ["dropped_incomplete_assertion", "dropped_missing_answer_value", "dropped_malformed_assertion",
                     "dropped_malformed_unit", "downgraded_unlinked_asserted_unit"]
REFUSALS = ["not enough information", "not enough info", "insufficient information", "unknown", "no answer", "none", ""]


def codes(*checks: tuple[Column, Column | str]) -> Column:
    """Distinct sorted codes of the conditions that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[
        F.when(cond, code if isinstance(code, Column) else F.lit(code)) for cond, code in checks]))))


def _outside(c, allowed: Sequence[str]) -> Column:
    return ~F.coalesce((F.col(c) if isinstance(c, str) else c).isin(list(allowed)), F.lit(False))


# -- queries ---------------------------------------------------------------

def publish_query(q: DataFrame) -> DataFrame:
    """query_text = question and the plan's lists joined by ' | '; only named columns leave, so no gold field can."""
    order = ["target_entities", "relation_queries", "value_queries", "event_queries", "temporal_queries",
             "lexical_expansions", "owner_roles", "required_evidence_acts"]
    have = q.schema["plan"].dataType.names
    lists = [F.col(f"plan.{k}") for k in order if k in have]
    parts = F.filter(F.concat(F.array("question"), *lists), lambda x: F.coalesce(x, F.lit("")) != "")
    given = F.nullif(F.col("query_text"), F.lit("")) if "query_text" in q.columns else F.lit(None).cast("string")
    keep = [c for c in ("sample_id", "conversation_id", "question") if c in q.columns]
    return q.select(*keep, F.coalesce(given, F.array_join(parts, " | ")).alias("query_text"),
                    F.col("plan.target_entities").alias("target_entities"), F.lit(False).alias("gold_visible"))


def validate_frames(df: DataFrame) -> DataFrame:
    """Identity and enum checks of a query frame; one-item lists given as text are lists, TIME means TIME_OWNER."""
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    roles = F.transform(arr("required_roles"), lambda x: F.when(x == "TIME", "TIME_OWNER").otherwise(x))
    d = df.withColumn("required_roles", roles)
    bad = lambda c, allowed: F.exists(arr(c), lambda x: _outside(x, allowed))
    return d.withColumn("errors", codes(
        (~F.col("sample_id").eqNullSafe(F.col("source_sample_id")) | ~F.col("question").eqNullSafe(F.col("source_question")), "IDENTITY_DRIFT"),
        (_outside("relation_family", RELATION_FAMILIES), "ENUM_RELATION_FAMILY"),
        (_outside("answer_type", ANSWER_TYPES), "ENUM_ANSWER_TYPE"),
        (_outside("evidence_shape", EVIDENCE_SHAPES), "ENUM_EVIDENCE_SHAPE"),
        (_outside("polarity_constraint", POLARITIES), "ENUM_POLARITY"),
        (_outside("modality_constraint", QUERY_MODALITIES), "ENUM_MODALITY"),
        (bad("required_roles", ROLES), "LIST_ENUM_REQUIRED_ROLES"),
        (bad("allowed_inference", INFERENCES), "LIST_ENUM_ALLOWED_INFERENCE")))


def list_or_scalar(json: Column, path: str) -> Column:
    """A JSON list of strings, where a lone string counts as a list of one."""
    raw = F.get_json_object(json, path)
    return F.when(raw.isNull(), F.lit(None).cast("array<string>")).when(
        F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def validate_plans(df: DataFrame, reply: str = "reply") -> DataFrame:
    """12-key contract of a plan given as JSON text."""
    c = F.col(reply)
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    value = lambda k: F.get_json_object(c, f"$.{k}")
    is_list = lambda k: F.coalesce(F.startswith(value(k), F.lit("[")), F.lit(False))
    empty = lambda k: ~is_list(k) & (F.coalesce(value(k), F.lit("")) == "") | F.coalesce(value(k) == "[]", F.lit(False))
    checks = [(F.size(F.array_except(keys, F.array(*map(F.lit, PLAN_KEYS)))) + F.size(
        F.array_except(F.array(*map(F.lit, PLAN_KEYS)), keys)) > 0, "KEY_CONTRACT"),
        (_outside(value("query_kind"), QUERY_KINDS), "QUERY_KIND_ENUM")]
    checks += [(~is_list(k), f"TYPE_{k.upper()}") for k in PLAN_LISTS]
    checks += [(empty(k), f"EMPTY_{k.upper()}") for k in PLAN_NONEMPTY]
    checks += [((value("query_kind") == "TEMPORAL") & empty("temporal_queries"), "EMPTY_TEMPORAL_QUERIES")]
    d = df.withColumn("errors", codes(*checks))
    return d.withColumn("status", F.when(F.size("errors") == 0, "VALIDATED").otherwise("UNCERTAIN"))


def answer_candidates(samples: DataFrame) -> DataFrame:
    """Ordered-unique acceptable answers, the canonical one, the evidence split and the question group."""
    cand = F.array_distinct(F.filter(F.concat("answer", "acceptable_answers"), lambda x: tx.strip(tx.text_of(x)) != ""))
    quality = F.lower(tx.strip(tx.text_of("quality")))
    return samples.withColumn("candidates", cand).withColumn(
        "canonical", F.coalesce(F.try_element_at("answer", F.lit(1)), F.lit(""))).withColumn(
        "split", F.when(quality.isin("gold", "silver", "bronze", "exclude"), quality).otherwise("unlabeled")).withColumn(
        "question_group", F.coalesce(F.nullif("question_type", F.lit("")), F.col("task_type")))


# -- memory responses ------------------------------------------------------

UNIT = "struct<unit_id:string,span:string,status:string,assertion_ids:array<string>,reason:string>"
FACT_TYPE = ("struct<assertion_id:string,subject:string,relation_family:string,surface_relation:string,"
             "answer_value:struct<type:string,value:string>,roles:map<string,string>,occurrence_local_id:string,"
             "modality:string,polarity:string,scope:struct<time_expression:string,time_owner:string,location:string>,"
             "retrieval_text:string,provenance:struct<raw_ids:array<string>,clause_ids:array<string>,unit_ids:array<string>>>")
MENTION = ("struct<text:string,canonical_entity:string,normalized:string,role:string,clause_id:string,"
           "clause_ids:array<string>,occurrence_local_id:string>")
MEMORY = (f"struct<center_raw_id:string,l1:struct<clause_units:array<struct<clause_id:string,units:array<{UNIT}>>>,"
          f"mentions:array<{MENTION}>>,l2_direct:array<{FACT_TYPE}>>")


def read_memory(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Typed memory of a JSON reply; unreadable replies keep a null memory and are quarantined by the caller."""
    return df.withColumn("memory", F.from_json(F.col(reply), MEMORY))


def repair_memory(df: DataFrame) -> DataFrame:
    """Lossless repairs of a typed memory against its request's clauses, each leaving a code.

    df: raw_id, clauses array<struct<clause_id,text>>, memory. Adds `memory` (repaired) and `repairs`.
    Everything is a nested expression over one response, so rows never leave their partition.
    """
    none = F.array().cast("array<string>")
    m, clause_ids = F.col("memory"), F.transform("clauses", lambda c: c["clause_id"])
    ids = F.when(F.size(clause_ids) > 0, clause_ids).otherwise(F.array(F.lit("c1")))
    arr = lambda c, ty: F.coalesce(c, F.array().cast(ty))

    # facts: enums fall to OTHER / UNKNOWN, provenance is pinned to this raw, incomplete facts go
    raw_facts = arr(m["l2_direct"], f"array<{FACT_TYPE}>")
    present = F.filter(raw_facts, lambda a: a.isNotNull())
    valued = F.filter(present, lambda a: a["answer_value"].isNotNull())
    enum = lambda c, allowed, other: F.when(_outside(c, allowed), other).otherwise(c)

    def fix_fact(a, i):
        cids = F.filter(arr(a["provenance"]["clause_ids"], "array<string>"), lambda x: F.array_contains(ids, x))
        return F.struct(
            F.coalesce(F.nullif(a["assertion_id"], F.lit("")), F.concat(F.lit("a"), i + 1)).alias("assertion_id"),
            a["subject"].alias("subject"), enum(a["relation_family"], RELATION_FAMILIES, "OTHER").alias("relation_family"),
            a["surface_relation"].alias("surface_relation"),
            F.struct(enum(a["answer_value"]["type"], ANSWER_TYPES, "OTHER").alias("type"), a["answer_value"]["value"].alias("value")).alias("answer_value"),
            F.coalesce(a["roles"], F.create_map().cast("map<string,string>")).alias("roles"), a["occurrence_local_id"].alias("occurrence_local_id"),
            enum(a["modality"], MODALITIES, "UNKNOWN").alias("modality"), enum(a["polarity"], POLARITIES, "UNKNOWN").alias("polarity"),
            F.coalesce(a["scope"], F.struct(*[F.lit(None).cast("string").alias(x) for x in ("time_expression", "time_owner", "location")])).alias("scope"),
            a["retrieval_text"].alias("retrieval_text"),
            F.struct(F.array("raw_id").alias("raw_ids"), F.when(F.size(cids) > 0, cids).otherwise(F.slice(ids, 1, 1)).alias("clause_ids"),
                     arr(a["provenance"]["unit_ids"], "array<string>").alias("unit_ids")).alias("provenance"))

    fixed = F.transform(valued, fix_fact)
    whole = lambda a: ((F.coalesce(a["subject"], F.lit("")) != "") & (F.coalesce(a["retrieval_text"], F.lit("")) != "")
                       & ~F.coalesce(a["answer_value"]["value"], F.lit("")).isin("", "scalar"))
    kept = F.filter(fixed, whole)
    kept_ids = F.transform(kept, lambda a: a["assertion_id"])

    # clauses: one entry per request clause, units with a closed status, links to kept facts only
    given = arr(m["l1"]["clause_units"], f"array<struct<clause_id:string,units:array<{UNIT}>>>")

    def fix_unit(u):
        links = arr(u["assertion_ids"], "array<string>")
        status = F.when(_outside(u["status"], UNIT_STATUSES), F.when(F.size(links) > 0, "ASSERTED").otherwise("UNRESOLVED")).otherwise(u["status"])
        live = F.filter(links, lambda x: F.array_contains(kept_ids, x))
        down = (status == "ASSERTED") & (F.size(live) == 0)
        return F.struct(u["unit_id"].alias("unit_id"), u["span"].alias("span"), F.when(down, "UNRESOLVED").otherwise(status).alias("status"),
                        live.alias("assertion_ids"), F.when(down, F.coalesce(F.nullif(u["reason"], F.lit("")), F.lit("MISSING_ASSERTION_LINK")))
                        .otherwise(u["reason"]).alias("reason"))

    def of_clause(cid):
        mine = F.filter(given, lambda g: g["clause_id"] == cid)
        units = F.filter(arr(F.try_element_at(mine, F.lit(-1))["units"], f"array<{UNIT}>"), lambda u: u.isNotNull())
        linked = F.transform(F.filter(kept, lambda a: F.array_contains(a["provenance"]["clause_ids"], cid)), lambda a: a["assertion_id"])
        text = F.coalesce(F.try_element_at(F.filter("clauses", lambda c: c["clause_id"] == cid), F.lit(1))["text"], F.lit(""))
        blank = F.size(units) == 0
        stand_in = F.struct(F.lit("u1").alias("unit_id"), text.alias("span"),
                            F.when(F.size(linked) > 0, "ASSERTED").otherwise("UNRESOLVED").alias("status"),
                            linked.alias("assertion_ids"), F.when(F.size(linked) == 0, "NO_VALID_UNIT").alias("reason"))
        return F.struct(cid.alias("clause_id"), F.when(blank, F.array(stand_in)).otherwise(F.transform(units, fix_unit)).alias("units"))

    units_out = F.transform(ids, of_clause)
    raw_units = lambda cid: F.coalesce(F.try_element_at(F.filter(given, lambda g: g["clause_id"] == cid), F.lit(-1))["units"],
                                       F.array().cast(f"array<{UNIT}>"))
    all_units = F.filter(F.flatten(F.transform(ids, raw_units)), lambda u: u.isNotNull())
    no_units = lambda cid: F.size(F.filter(raw_units(cid), lambda u: u.isNotNull())) == 0
    has_fact = lambda cid: F.exists(kept, lambda a: F.array_contains(a["provenance"]["clause_ids"], cid))

    # mentions: anchored to a clause, role closed
    mentions = arr(m["l1"]["mentions"], f"array<{MENTION}>")
    live_m = F.filter(mentions, lambda x: x.isNotNull())

    def anchor(x):
        cites = F.filter(arr(x["clause_ids"], "array<string>"), lambda c: F.array_contains(ids, c))
        return F.when(F.array_contains(ids, x["clause_id"]), x["clause_id"]).when(F.size(cites) == 1, F.try_element_at(cites, F.lit(1))).when(
            F.size(ids) == 1, F.try_element_at(ids, F.lit(1)))

    mentions_out = F.filter(F.transform(live_m, lambda x: F.struct(
        x["text"].alias("text"), F.coalesce(x["canonical_entity"], x["normalized"]).alias("canonical_entity"),
        enum(x["role"], ROLES, "UNKNOWN").alias("role"), anchor(x).alias("clause_id"), x["occurrence_local_id"].alias("occurrence_local_id"))),
        lambda x: x["clause_id"].isNotNull())

    any_ = F.exists
    status_bad = lambda u: _outside(u["status"], UNIT_STATUSES)
    settled = lambda u: F.when(status_bad(u), F.when(F.size(arr(u["assertion_ids"], "array<string>")) > 0, "ASSERTED").otherwise("UNRESOLVED")).otherwise(u["status"])
    repairs = codes(
        (m["l1"].isNull(), "missing_l1_wrapper"), (m["l1"]["clause_units"].isNull(), "missing_clause_units"),
        (any_(given, lambda g: g.isNull()), "dropped_malformed_clause_unit"),
        (any_(F.filter(given, lambda g: g.isNotNull() & F.array_contains(ids, g["clause_id"])), lambda g: g["units"].isNull()), "normalized_units_list"),
        (any_(F.flatten(F.transform(ids, raw_units)), lambda u: u.isNull()), "dropped_malformed_unit"),
        (any_(all_units, lambda u: u["assertion_ids"].isNull()), "normalized_assertion_ids"),
        (any_(all_units, status_bad), "normalized_unit_status"), (any_(ids, no_units), "inserted_unresolved_unit"),
        (m["l1"].isNotNull() & m["l1"]["mentions"].isNull() | m["l1"].isNull(), "normalized_mentions"),
        (any_(mentions, lambda x: x.isNull()), "dropped_malformed_mention"),
        (any_(live_m, lambda x: ~F.coalesce(F.array_contains(ids, x["clause_id"]), F.lit(False)) & anchor(x).isNotNull()), "normalized_mention_provenance"),
        (any_(live_m, lambda x: anchor(x).isNull()), "dropped_unanchored_mention"),
        (any_(live_m, lambda x: anchor(x).isNotNull() & _outside(x["role"], ROLES)), "normalized_mention_role"),
        (any_(raw_facts, lambda a: a.isNull()), "dropped_malformed_assertion"),
        (any_(present, lambda a: a["answer_value"].isNull()), "dropped_missing_answer_value"),
        (any_(valued, lambda a: F.coalesce(a["assertion_id"], F.lit("")) == ""), "generated_local_assertion_id"),
        (any_(valued, lambda a: _outside(a["answer_value"]["type"], ANSWER_TYPES)), "normalized_answer_type"),
        (any_(valued, lambda a: _outside(a["relation_family"], RELATION_FAMILIES)), "normalized_relation_family"),
        (any_(valued, lambda a: _outside(a["modality"], MODALITIES)), "normalized_modality"),
        (any_(valued, lambda a: _outside(a["polarity"], POLARITIES)), "normalized_polarity"),
        (any_(valued, lambda a: a["roles"].isNull()), "normalized_roles"), (any_(valued, lambda a: a["scope"].isNull()), "normalized_scope"),
        (any_(valued, lambda a: a["provenance"].isNull()), "normalized_provenance"),
        (any_(valued, lambda a: ~a["provenance"]["raw_ids"].eqNullSafe(F.array("raw_id"))), "normalized_raw_provenance"),
        (any_(valued, lambda a: F.size(F.array_intersect(arr(a["provenance"]["clause_ids"], "array<string>"), ids)) == 0), "normalized_clause_provenance"),
        (any_(fixed, lambda a: ~whole(a)), "dropped_incomplete_assertion"),
        (any_(all_units, lambda u: (settled(u) == "ASSERTED") & (F.size(F.array_intersect(arr(u["assertion_ids"], "array<string>"), kept_ids)) == 0)),
         "downgraded_unlinked_asserted_unit"),
        (any_(ids, lambda c: no_units(c) & has_fact(c)), "reconstructed_unit_from_assertion_provenance"))
    out = F.struct(F.coalesce(m["center_raw_id"], F.col("raw_id")).alias("center_raw_id"),
                   F.struct(units_out.alias("clause_units"), mentions_out.alias("mentions")).alias("l1"), kept.alias("l2_direct"))
    return df.withColumn("repairs", repairs).withColumn("memory", out)


def adapt_memory(df: DataFrame) -> DataFrame:
    """The alternative response shape (one flat assertion list citing clauses) in the canonical shape.

    df: raw_id, clauses, assertions array<struct<assertion_id,subject,relation_family,surface_relation,
    answer_type,value,role,clause_ids,time,modality,polarity>>
    """
    s = lambda c, d="": F.coalesce(F.nullif(c, F.lit("")), F.lit(d))

    def fact(a, i):
        rel = F.coalesce(F.nullif(a["surface_relation"], F.lit("")), F.nullif(a["relation_family"], F.lit("")), F.lit("OTHER"))
        kind = s(a["answer_type"], "OTHER")
        return F.struct(
            F.coalesce(F.nullif(a["assertion_id"], F.lit("")), F.concat(F.lit("a"), i + 1)).alias("assertion_id"), s(a["subject"]).alias("subject"),
            s(a["relation_family"], "OTHER").alias("relation_family"), rel.alias("surface_relation"),
            F.struct(F.when(kind.isin(ANSWER_TYPES), kind).otherwise("OTHER").alias("type"), a["value"].alias("value")).alias("answer_value"),
            F.create_map(s(a["role"], "ANSWER_VALUE"), s(a["subject"])).alias("roles"), s(a["modality"], "UNKNOWN").alias("modality"),
            s(a["polarity"], "UNKNOWN").alias("polarity"), a["time"].alias("time_expression"),
            tx.join_nonblank(" ", s(a["subject"]), rel, a["value"]).alias("retrieval_text"),
            F.coalesce(a["clause_ids"], F.array().cast("array<string>")).alias("clause_ids"))

    facts = F.transform("assertions", fact)

    def unit(c, i):
        ids = F.transform(F.filter(facts, lambda a: F.array_contains(a["clause_ids"], c["clause_id"])), lambda a: a["assertion_id"])
        held = F.size(ids) > 0
        return F.struct(c["clause_id"].alias("clause_id"), F.concat(F.lit("u"), i + 1).alias("unit_id"), tx.text_of(c["text"]).alias("span"),
                        F.when(held, "ASSERTED").otherwise("NON_PROPOSITIONAL").alias("status"), ids.alias("assertion_ids"),
                        F.when(~held, "NO_DIRECT_ASSERTION").alias("reason"))

    return df.select("raw_id", F.transform("clauses", unit).alias("units"), facts.alias("facts"))


def clause_coverage(units: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per raw: clauses left out, foreign, repeated, without units, or with a bad unit status.

    units: raw_id, clause_id, status (one row per unit, null status = empty); clauses: raw_id, clause_id
    """
    entry = units.groupBy("raw_id", "clause_id", "entry").agg(
        F.max(_outside("status", UNIT_STATUSES)).alias("bad"), F.count("status").alias("n"))
    per = entry.groupBy("raw_id", "clause_id").agg(F.count(F.lit(1)).alias("times"), F.max("bad").alias("bad"), F.min("n").alias("n"))
    j = clauses.withColumn("known", F.lit(True)).join(per, ["raw_id", "clause_id"], "full_outer")
    return j.groupBy("raw_id").agg(
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("foreign"),
        F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("n") == 0).alias("empty"),
        F.count_if(F.col("bad") & (F.col("n") > 0)).alias("bad_status"))


def link_integrity(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Violations of the fact–unit links, one row each.

    facts: raw_id, ord, assertion_id, clause_ids, unit_ids; units: raw_id, clause_id, unit_id, status, span, assertion_ids
    """
    f = facts.withColumn("global_id", F.concat("raw_id", F.lit("::l2::"), F.col("ord")))
    live = F.explode_outer("assertion_ids")
    linked = units.select("raw_id", "unit_id", live.alias("assertion_id")).join(f.select("raw_id", "assertion_id", "global_id"), ["raw_id", "assertion_id"])
    counts = linked.groupBy("raw_id", "unit_id").agg(F.count(F.lit(1)).alias("n_links"))
    u = units.join(counts, ["raw_id", "unit_id"], "left")
    span = tx.strip(tx.text_of("span"))
    unit_bad = u.select("raw_id", F.col("unit_id").alias("item"), F.explode(codes(
        (span == "", "unit_span_empty"), (span.rlike(r"^\d+\s*[-:]\s*\d+$"), "unit_span_is_range"),
        ((F.col("status") == "ASSERTED") & F.col("n_links").isNull(), "asserted_unit_without_assertion"))).alias("violation"))
    cited = f.select("raw_id", "global_id", "assertion_id", "clause_ids", F.explode("unit_ids").alias("unit_id")).join(
        units.select("raw_id", "unit_id", "clause_id", "status", "assertion_ids"), ["raw_id", "unit_id"])
    cite_bad = cited.select("raw_id", F.col("global_id").alias("item"), F.explode(codes(
        (~F.array_contains("clause_ids", F.col("clause_id")), "assertion_unit_clause_mismatch"),
        (F.col("status") != "ASSERTED", "assertion_points_to_non_asserted_unit"),
        (~F.array_contains("assertion_ids", F.col("assertion_id")), "link_mismatch"))).alias("violation"))
    none = f.where(F.coalesce(F.size("unit_ids"), F.lit(0)) <= 0).select("raw_id", F.col("global_id").alias("item"), F.lit("assertion_missing_unit_ids").alias("violation"))
    return unit_bad.unionByName(cite_bad).unionByName(none)


def normalize_contextual(df: DataFrame) -> DataFrame:
    """Safe repairs of a contextual record: misused dependency labels, self-antecedents, unanchored links."""
    dep = F.col("context_dependency")
    own = lambda a: F.filter(a, lambda x: x != F.col("raw_id"))
    return (df.withColumn("context_dependency", F.when(dep == "QUESTION", "OTHER").when(dep == "NON_PROPOSITIONAL", "NONE").otherwise(dep))
            .withColumn("antecedent_raw_ids", own("antecedent_raw_ids"))
            .withColumn("speech_acts", F.transform("speech_acts", lambda a: a.withField("antecedent_raw_ids", own(a["antecedent_raw_ids"]))))
            .withColumn("occurrence_links", F.filter("occurrence_links", lambda x: (F.size(x["antecedent_raw_ids"]) > 0)
                                                     & (F.size(F.array_except(x["antecedent_raw_ids"], F.col("supplied"))) == 0))))


def validate_contextual(df: DataFrame) -> DataFrame:
    """Indexed error codes of a contextual record against its supplied neighbours.

    df: raw_id, supplied array<string>, context_dependency, antecedent_raw_ids, speech_acts, occurrence_links
    """
    none = F.array().cast("array<string>")
    rid, supplied = F.col("raw_id"), F.col("supplied")
    ants = lambda c: F.coalesce(c, none)
    foreign = lambda c: F.array_contains(ants(c), rid) | (F.size(F.array_except(ants(c), supplied)) > 0)
    acts, links = F.coalesce("speech_acts", F.array()), F.coalesce("occurrence_links", F.array())
    tag = lambda kind, i, what: F.concat(F.lit(kind + "_"), i, F.lit("_" + what))
    act_codes = F.flatten(F.transform(acts, lambda a, i: F.array(
        F.when(_outside(a["act"], SPEECH_ACTS), tag("ACT", i, "ENUM")), F.when(foreign(a["antecedent_raw_ids"]), tag("ACT", i, "ANTECEDENT")),
        F.when(F.coalesce(a["act"].isin(NEEDS_ANTECEDENT), F.lit(False)) & (F.size(ants(a["antecedent_raw_ids"])) == 0), tag("ACT", i, "MISSING_ANTECEDENT")),
        F.when(a["resolved_proposition"].isNotNull() & (
            ~F.array_contains(ants(a["resolved_proposition"]["source_raw_ids"]), rid)
            | (F.size(F.array_except(ants(a["resolved_proposition"]["source_raw_ids"]), F.array_append(supplied, rid))) > 0)), tag("ACT", i, "SOURCES")))))
    link_codes = F.transform(links, lambda x, i: F.when(
        (F.size(ants(x["antecedent_raw_ids"])) == 0) | (F.size(F.array_except(ants(x["antecedent_raw_ids"]), supplied)) > 0), tag("OCCURRENCE", i, "ANTECEDENT")))
    top = F.array(F.when(_outside("context_dependency", DEPENDENCIES), "CONTEXT_DEPENDENCY_ENUM"),
                  F.when(F.col("antecedent_raw_ids").isNull(), "TYPE_ANTECEDENTS"), F.when(foreign(F.col("antecedent_raw_ids")), "INVALID_ANTECEDENT"),
                  F.when(F.col("speech_acts").isNull(), "TYPE_SPEECH_ACTS"), F.when(F.col("occurrence_links").isNull(), "TYPE_OCCURRENCE_LINKS"))
    return df.withColumn("errors", F.array_sort(F.array_distinct(F.array_compact(F.concat(top, act_codes, link_codes)))))


def validate_merge(supersessions: DataFrame, merged: DataFrame, prior_ids: DataFrame, sources: DataFrame) -> DataFrame:
    """Violations of a merged-memory contract, one row each.

    supersessions: conversation_id, old_assertion_id, source_raw_ids; merged: conversation_id, assertion_id, status, source_raw_ids
    """
    old = supersessions.join(prior_ids.select("conversation_id", F.col("assertion_id").alias("old_assertion_id")),
                             ["conversation_id", "old_assertion_id"], "left_anti").select(
        "conversation_id", F.col("old_assertion_id").alias("item"), F.lit("unknown_old_assertion").alias("violation"))
    known = sources.select("conversation_id", F.col("raw_id").alias("source"))

    def foreign(df, item, code):
        return df.select("conversation_id", F.col(item).alias("item"), F.explode("source_raw_ids").alias("source")).join(
            known, ["conversation_id", "source"], "left_anti").select("conversation_id", "item", F.lit(code).alias("violation")).distinct()

    bad = merged.where(_outside("status", MERGE_STATUSES)).select("conversation_id", F.col("assertion_id").alias("item"), F.lit("bad_status").alias("violation"))
    return old.unionByName(foreign(supersessions, "old_assertion_id", "unknown_supersession_source")).unionByName(bad).unionByName(
        foreign(merged, "assertion_id", "unknown_assertion_source"))


def category_cover(items: DataFrame, proposals: DataFrame, layer: int = 1) -> DataFrame:
    """Categories over indexed items: bad names and out-of-range members go, uncovered items stand alone.

    items: scope, idx, name; proposals: scope, ord, name, members array<int>. A layer above
    the first that does not compress its items yields no rows for that scope.
    """
    name, low = tx.strip(tx.text_of("name")), F.lower(tx.strip(tx.text_of("name")))
    p = proposals.where((name != "") & ~F.contains(low, F.lit(" and ")) & ~low.isin(BANNED_CATEGORIES)).withColumn("low", low).withColumn("category", name)
    members = p.select("scope", "ord", "low", "category", F.explode(F.array_distinct("members")).alias("idx")).join(items.select("scope", "idx"), ["scope", "idx"])
    first = members.groupBy("scope", "low").agg(F.min("ord").alias("ord"))
    kept = members.join(first, ["scope", "low", "ord"]).select("scope", "category", "idx")
    item_name, item_low = tx.strip(tx.text_of("name")), F.lower(tx.strip(tx.text_of("name")))
    alone = items.join(kept.select("scope", "idx").distinct(), ["scope", "idx"], "left_anti").select(
        "scope", F.when(item_low.isin("user", "i", "me"), "Speaker").when(item_name == "", F.concat(F.lit("Node "), F.col("idx"))).otherwise(item_name).alias("category"),
        "idx", F.lit(True).alias("singleton"))
    out = kept.withColumn("singleton", F.lit(False)).unionByName(alone)
    if layer <= 1:
        return out
    n_cat = kept.groupBy("scope").agg(F.countDistinct("category").alias("a")).join(
        alone.groupBy("scope").agg(F.count(F.lit(1)).alias("b")), "scope", "full_outer").join(items.groupBy("scope").agg(F.count(F.lit(1)).alias("n")), "scope")
    fine = n_cat.where(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) < F.col("n")).select("scope")
    return out.join(fine, "scope", "left_semi")


# -- answers and checks ----------------------------------------------------

def valid_citations(citations: DataFrame, packet: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Adds `valid`: the raw is in the packet and its text or caption holds the quote."""
    flat = lambda c: F.array_join(tx.find_all(tx.text_of(c), r"\S+"), " ")
    j = citations.join(packet, [*keys, "raw_id"], "left")
    held = F.contains(flat("original_text"), flat("quote")) | F.contains(flat("image_caption"), flat("quote"))
    ok = (tx.strip(tx.text_of("quote")) != "") & F.coalesce(held & F.col("original_text").isNotNull(), F.lit(False))
    return j.withColumn("valid", ok).drop("original_text", "image_caption")


def validate_claims(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claim certificate: every citation valid, a derivation if DERIVED, literals quoted if DIRECT.

    claims: sample_id, claim_no, claim, support_type, derivation; citations: …, quote, valid
    """
    c = citations.groupBy("sample_id", "claim_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("quote")))), " ").alias("quotes"))
    j = claims.join(c, ["sample_id", "claim_no"], "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("n_valid", F.lit(0))
    direct = F.col("support_type") == "DIRECT"
    return j.withColumn("citations_valid", (n == ok) & (ok > 0) & (direct | (tx.strip(tx.text_of("derivation")) != ""))
                        & (~direct | tx.literals_supported("claim", tx.text_of("quotes")))).withColumn(
        "n_valid", ok).drop("n", "quotes")


def normalize_check(df: DataFrame) -> DataFrame:
    """Downgrades of a checker row that its own evidence does not carry.

    df: question, answer_support, requirement_coverage, target_alignment, decision,
    requirements array<struct<need,status,n_citations,n_valid>>, gaps array<struct<gap_id,retrieval_query,retrievable>>,
    resolved_gaps, prior_gap_ids, n_invalid_claims
    """
    reqs = F.filter("requirements", lambda r: r["status"].isin("SUPPORTED", "MISSING", "UNCERTAIN"))
    weak = lambda r: (r["status"] == "SUPPORTED") & (r["n_valid"] == 0)
    fixed = F.transform(reqs, lambda r: r.withField("status", F.when(weak(r), "UNCERTAIN").otherwise(r["status"])))
    gaps = F.filter(F.slice("gaps", 1, 2), lambda g: g["retrievable"] & (tx.strip(tx.text_of(g["retrieval_query"])) != ""))
    d0 = F.col("decision")
    d1 = F.when((d0 == "RETRIEVE") & (F.size(gaps) == 0), "REJECT_UNSUPPORTED").otherwise(d0)
    bad_keep = (d1 == "KEEP") & ((F.col("answer_support") != "SUPPORTED") | (F.col("target_alignment") != "ALIGNED"))
    d2 = F.when(bad_keep, "REJECT_UNSUPPORTED").otherwise(d1)
    uncert = (F.col("n_invalid_claims") > 0) & d2.isin("KEEP", "USE_REVISED")
    synthetic = F.array(F.struct(F.lit("certificate_support").alias("gap_id"), F.concat(
        "question", F.lit(" Find the explicit answer-bearing evidence and distinguish competing occurrences.")).alias("retrieval_query"), F.lit(True).alias("retrievable")))
    issues = codes(
        (F.size("requirements") > F.size(reqs), "invalid_requirement"), (F.exists(reqs, lambda r: r["n_valid"] < r["n_citations"]), "invalid_citation"),
        (F.exists(reqs, weak), "unsupported_support_claim"), (F.size(reqs) == 0, "requirements_fallback"), (F.size("gaps") > 2, "gap_truncated"),
        ((d0 == "RETRIEVE") & (F.size(gaps) == 0), "retrieve_without_actionable_gap"), (bad_keep, "invalid_keep_downgrade"), (uncert, "answer_certificate_invalid"))
    fallback = F.array(F.struct(F.lit("Verify the proposed answer against explicit evidence.").alias("need"), F.lit("UNCERTAIN").alias("status"),
                                F.lit(0).cast("bigint").alias("n_citations"), F.lit(0).cast("bigint").alias("n_valid")))
    return df.select(
        *[c for c in df.columns if c not in ("decision", "answer_support", "requirement_coverage", "requirements", "gaps", "resolved_gaps")],
        F.when(uncert, "RETRIEVE").otherwise(d2).alias("decision"), F.when(uncert, "UNSUPPORTED").otherwise(F.col("answer_support")).alias("answer_support"),
        F.when(uncert, "INCOMPLETE").otherwise(F.col("requirement_coverage")).alias("requirement_coverage"),
        F.when(F.size(reqs) == 0, fallback).otherwise(fixed).alias("requirements"), F.when(uncert & (F.size(gaps) == 0), synthetic).otherwise(gaps).alias("gaps"),
        F.array_intersect("resolved_gaps", "prior_gap_ids").alias("resolved_gaps"), issues.alias("issues"))


def should_retrieve(df: DataFrame) -> DataFrame:
    return df.withColumn("retrieve", (F.col("decision") == "RETRIEVE") & (F.size("gaps") > 0))


def select_answer(df: DataFrame) -> DataFrame:
    """Direct or revised answer with the reason; a revision that is not fully supported loses.

    df: direct, revised, decision, answer_support, target_alignment, conflict_status, requirement_coverage,
    claims array<struct<citations_valid,raw_ids>>, added array<string>, resolved_gaps
    """
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    claims = F.coalesce("claims", F.array())
    reason = (F.when((n("added") <= 0) | F.col("revised").isNull() | F.col("decision").isNull(), "no_qualified_new_evidence")
              .when((F.col("decision") != "USE_REVISED") | (F.col("answer_support") != "SUPPORTED"), "revision_not_verified")
              .when((F.col("target_alignment") != "ALIGNED") | (F.col("conflict_status") != "NONE"), "revision_target_or_conflict")
              .when(F.col("requirement_coverage") != "COMPLETE", "revision_incomplete")
              .when((F.size(claims) == 0) | F.exists(claims, lambda c: (F.size(c["raw_ids"]) == 0) | ~c["citations_valid"]), "revision_citations_invalid")
              .when(~F.exists(claims, lambda c: F.arrays_overlap(c["raw_ids"], F.col("added"))), "revision_has_no_new_support")
              .when(n("resolved_gaps") <= 0, "no_resolved_gap").otherwise("verified_revision"))
    return df.withColumn("selection_reason", reason).withColumn(
        "final_answer", F.when(F.col("selection_reason") == "verified_revision", F.col("revised")).otherwise(F.col("direct")))


def auto_verdict(rows: DataFrame) -> DataFrame:
    """Rows settled without a judge: a strict match, or a refusal where category 5 has no gold answer.

    rows: question_type, gold_answer, candidates array<string>, pred_answer
    """
    pred = tx.normalize_answer("pred_answer")
    gold = F.filter(F.transform("candidates", tx.normalize_answer), lambda g: g != "")
    strict = (pred != "") & F.exists(gold, lambda g: F.contains(pred, g))
    refusal = (F.col("question_type") == "5") & (tx.normalize_answer("gold_answer") == "") & pred.isin(REFUSALS)
    return rows.withColumn("verdict_source", F.when(refusal, "auto_empty_answer").when(strict, "auto_strict").otherwise("judge")).withColumn(
        "judge_label", F.when(F.col("verdict_source") != "judge", "correct"))


def promote(df: DataFrame, manifest: DataFrame, allowed: Sequence[str] = PERMANENT_REPAIRS) -> DataFrame:
    """Records whose repairs are all permitted enter the manifest with a content hash, replacing older rows.

    df: idx, raw_id, content, repairs; manifest: idx, raw_id, content_sha256, status, repairs
    """
    ok = df.where(F.size(F.array_except("repairs", F.array(*map(F.lit, allowed)))) == 0).select(
        "idx", "raw_id", F.sha2("content", 256).alias("content_sha256"), F.lit("CONTENT_VALIDATED_PERMANENT").alias("status"),
        F.array_join(F.array_sort("repairs"), ",").alias("repairs"))
    return overlay(manifest, ok, ["idx"])


def revoke(manifest: DataFrame, targets: DataFrame, at: str):
    """Mark manifest rows SUPERSEDED and return the history rows that record it.

    targets: idx, reason
    """
    t = targets.select("idx", "reason")
    j = manifest.join(t, "idx", "left")
    live = F.col("reason").isNotNull() & (F.col("status") == "CONTENT_VALIDATED_PERMANENT")
    keep = [c for c in manifest.columns if c not in ("status", "reason", "superseded_at")]
    new = j.select(*keep, F.when(live, "SUPERSEDED").otherwise(F.col("status")).alias("status"), F.when(live, F.col("reason")).alias("reason"), F.when(live, F.lit(at)).alias("superseded_at"))
    history = new.where("superseded_at is not null").select("idx", F.col("content_sha256").alias("old_content_sha256"), "status", "reason", "superseded_at")
    return new, history


def split_cached(requests: DataFrame, cache: DataFrame, identity: Sequence[str] = ("model", "prompt_sha", "ontology_sha")):
    """Requests answered by the cache, and the rest as the next request table.

    The key covers the payload and the identity columns, so a changed model or prompt misses.
    """
    key = tx.content_key(payload=F.col("payload"), **{c: F.col(c) for c in identity})
    r = requests.withColumn("request_key", key)
    c = cache.select("request_key", "response").dropDuplicates(["request_key"])
    return r.join(c, "request_key"), r.join(c, "request_key", "left_anti")


def missing_gold(rows: DataFrame, examples: int = 20):
    """How many rows lack a gold answer, and the first few by id."""
    bad = rows.where(tx.strip(tx.text_of("gold_answer")) == "")
    return bad.agg(F.count(F.lit(1)).alias("n_missing")), bad.orderBy("sample_id").limit(examples)
