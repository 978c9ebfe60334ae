"""Decision rules, text rendering and repairs on hand-written rows."""
import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.functions.python_udfs import score_pairs, stem_word
from turnwise.operators import contracts as ct, diagnostics as dg, metrics as me, rowset as rs


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("parts,want", [
    (("Ann bought a car", "Ann", "bought", "car", None, None), "Ann bought a car"),
    (("", "Ann", "count", "0", None, "May"), "subject: Ann | relation: count | value: 0 | time: May"),
    (("Ann did not go", "ann", "go", "not", "party", ""), "Ann did not go | event: party"),
])
def test_render_assertion(spark, parts, want):
    assert one(spark, tx.render_assertion(*[F.lit(p).cast("string") for p in parts])) == want


def test_split_clauses(spark):
    assert one(spark, tx.split_clauses(F.lit("One. Two; three — four, but five"))) == ["One.", "Two", "three", "four", "but five"]
    assert one(spark, tx.split_clauses(F.lit("  "))) == ["empty"]
    assert one(spark, tx.split_clauses(F.lit("a 0. b 1"))) == ["a 0.", "b 1"]


@pytest.mark.parametrize("text,status,subjects,want", [
    ("Yes, I did", "ASSERTED", ["Ann"], "CONTEXT_REPARSE_REQUIRED"), ("It was fun", "ASSERTED", ["it"], "CONTEXT_REPARSE_REQUIRED"),
    ("It was fun", "ASSERTED", ["Ann"], "SELF_CONTAINED_LLM"), ("Ann runs", "UNRESOLVED", [], "CONTEXT_REPARSE_REQUIRED"),
    ("Yes", "NON_PROPOSITIONAL", [], "SELF_CONTAINED_LLM"), ("it " * 100, "ASSERTED", [], "SELF_CONTAINED_LLM")])
def test_context_gate(spark, text, status, subjects, want):
    subs = F.array(*[F.lit(s) for s in subjects]) if subjects else F.array().cast("array<string>")
    assert one(spark, tx.context_gate(F.lit(text), F.array(F.lit(status)), subs)) == want


def test_dates_and_timestamps(spark):
    got = one(spark, tx.extract_dates(F.lit("on 8 May 2023, May 9th, 2023, 2023/5/1 and 31 February 2023")))
    assert got == ["2023-05-01", "2023-05-08", "2023-05-09"]
    assert one(spark, F.date_format(tx.parse_timestamp(F.lit("1:56 pm on 8 May, 2023")), "yyyy-MM-dd HH:mm")) == "2023-05-08 13:56"
    assert one(spark, tx.parse_timestamp(F.lit("tomorrow"))) is None


def test_stems():
    pairs = dict(caresses="caress", ponies="poni", ties="tie", agreed="agre", plastered="plaster", hopping="hop", filing="file", happy="happi",
                 relational="relat", generalizations="gener", oscillators="oscil", dying="die", enjoy="enjoy", controll="control")
    assert {w: stem_word(w) for w in pairs} == pairs


def test_category_f1_rules(spark):
    df = spark.createDataFrame([("a", "1", "cats, dogs", "dog, cat, bird"), ("b", "3", "yes", "yes; because"), ("c", "2", "running fast", "runs")],
                               "sample_id string, category string, pred_answer string, gold_answer string")
    got = {r.sample_id: r.category_f1 for r in me.category_f1(df).collect()}
    assert abs(got["a"] - 2 / 3) < 1e-9 and got["b"] == 1.0 and abs(got["c"] - 2 / 3) < 1e-9


def test_empty_sides_of_f1(spark):
    df = spark.createDataFrame([("a", "", ""), ("b", "x", "")], "sample_id string, pred_answer string, gold_answer string")
    assert {r.sample_id: r.token_f1 for r in me.token_f1(df, ["sample_id"]).collect()} == {"a": 1.0, "b": 0.0}
    assert {r.sample_id: r.bleu_1 for r in me.bleu1_smoothed(df, ["sample_id"]).collect()} == {"a": 0.0, "b": 0.0}


def test_contextual_codes_and_normaliser(spark):
    act = "array<struct<act:string,antecedent_raw_ids:array<string>,resolved_proposition:struct<source_raw_ids:array<string>>>>"
    df = spark.createDataFrame([("r", ["n"], "QUESTION", ["r"], [("CONFIRMATION", [], None)], [(["zz"],)])],
                               f"raw_id string, supplied array<string>, context_dependency string, antecedent_raw_ids array<string>, speech_acts {act}, occurrence_links array<struct<antecedent_raw_ids:array<string>>>")
    assert ct.validate_contextual(df).first().errors == ["ACT_0_MISSING_ANTECEDENT", "CONTEXT_DEPENDENCY_ENUM", "INVALID_ANTECEDENT", "OCCURRENCE_0_ANTECEDENT"]
    after = ct.validate_contextual(ct.normalize_contextual(df)).first()
    assert after.errors == ["ACT_0_MISSING_ANTECEDENT"] and after.context_dependency == "OTHER"


def test_repair_relinks_a_malformed_wrapper(spark):
    fact = ('{"assertion_id":"a1","subject":"Ann","relation_family":"ODD","surface_relation":"has","answer_value":{"type":"COUNT","value":"2"},'
            '"retrieval_text":"Ann has 2","provenance":{"clause_ids":["c1"]}}')
    df = spark.createDataFrame([("r", [("c1", "Ann has two")], '{"l2_direct":[' + fact + ']}'), ("s", [("c1", "x")], "{}")], "raw_id string, clauses array<struct<clause_id:string,text:string>>, reply string")
    got = {r.raw_id: r for r in ct.repair_memory(ct.read_memory(df)).collect()}
    u = got["r"].memory.l1.clause_units[0].units[0]
    assert u.status == "ASSERTED" and u.assertion_ids == ["a1"] and got["r"].memory.l2_direct[0].relation_family == "OTHER"
    assert "reconstructed_unit_from_assertion_provenance" in got["r"].repairs and "missing_l1_wrapper" in got["r"].repairs
    assert got["s"].memory.l1.clause_units[0].units[0].status == "UNRESOLVED"


def test_prefer_ok_and_latest(spark):
    df = spark.createDataFrame([("a", 1, "ok"), ("a", 2, None), ("b", 1, None), ("b", 2, None)], "k string, p int, v string")
    assert {r.k: r.p for r in rs.prefer_ok(df, ["k"], F.col("v").isNotNull(), "p").collect()} == {"a": 1, "b": 2}
    assert {r.k: (r.p, r.first_position) for r in rs.latest_wins(df, ["k"], "p").collect()} == {"a": (2, 1), "b": (2, 1)}


def test_evidence_rules_and_similarity(spark):
    df = spark.createDataFrame([("a", "the red car", "a b the red car c"), ("b", "one two three four five", "five four three two"), ("c", "abcdefghij klmnop", "abcdefghij klmnoq"), ("d", "x", "y"), ("e", "", "y")],
                               "pair_id string, unit string, text string")
    assert {r.pair_id: r.rule for r in dg.evidence_in_text(df).collect()} == {"a": "contains", "b": "coverage", "c": "fuzzy", "d": None, "e": "empty"}
    p = spark.createDataFrame([("same", "A b", "a  B!", None, None), ("vec", "a", "b", [1.0, 0.0], [0.0, 1.0]), ("lex", "a b c", "a b d", None, None), ("none", "", "b", None, None)],
                              "pair_id string, a string, b string, va array<double>, vb array<double>")
    got = {r.pair_id: r.similarity for r in dg.text_similarity(p).collect()}
    assert got["same"] == 1.0 and got["vec"] == 0.0 and got["none"] == 0.0 and abs(got["lex"] - 0.8) < 1e-9, got


def test_duplicate_pairs_equal_brute_force(spark):
    import itertools
    import random
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(40)]
    df = spark.createDataFrame([("s", f"{i:02d}", t) for i, t in enumerate(texts)], "sample_id string, text_id string, text string")
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    want = {(f"{i:02d}", f"{j:02d}") for i, j in itertools.combinations(range(40), 2) if jac(texts[i], texts[j]) > 0.85}
    assert {(r.text_id, r.other_id) for r in dg.duplicate_pairs(df).collect()} == want


def test_probe_orders_ids_descending(spark):
    q = spark.createDataFrame([("s", "s", "zzz")], "sample_id string, conversation_id string, query_text string")
    e = spark.createDataFrame([("s", x, "text") for x in "abc"], "conversation_id string, raw_id string, text string")
    sim = spark.createDataFrame([("s", x, 0.5) for x in "abc"], "sample_id string, raw_id string, score double")
    assert [r.raw_id for r in dg.standard_probe(q, e, sim, None, 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_scorer_must_score_every_row(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "v int")
    assert {r.v: r.score for r in score_pairs(df, lambda pdf: pdf["v"] * 2.0).collect()} == {i: 2.0 * i for i in range(6)}
    for bad in (lambda pdf: pdf["v"].where(pdf["v"] != 3), lambda pdf: pdf["v"].iloc[:0], lambda pdf: 1 / 0):
        with pytest.raises(Exception, match="PYTHON|score|ZeroDivision"):
            score_pairs(df, bad).collect()


def test_ranked_evidence_and_duplicates_equal_those_of_copied_texts(spark):
    import random
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choices("abcdef", k=n))
    turns = [("c", f"t{i:02d}", text(rng.randint(1, 6))) for i in range(30)] + [("d", f"u{i}", text(4)) for i in range(5)]
    rank = [(f"s{q}", f"t{i:02d}") for q in range(6) for i in rng.sample(range(30), 12)] + [("z", f"u{i}") for i in range(5)]
    units = [(f"s{q}", "c", f"n{i}", text(rng.randint(1, 5))) for q in range(6) for i in range(3)] + [("z", "d", "n0", "a b")]
    r = spark.createDataFrame(turns, "conversation_id string, text_id string, text string")
    k = spark.createDataFrame(rank, "sample_id string, text_id string")
    u = spark.createDataFrame(units, "sample_id string, conversation_id string, unit_id string, unit string")
    copies = k.join(r, "text_id")
    want = {tuple(x) for x in dg.evidence_pairs(u, copies).select("sample_id", "unit_id", "text_id").collect()}
    got = [tuple(x) for x in dg.ranked_evidence_pairs(u, r, k).collect()]
    assert want and set(got) == want and len(got) == len(want)
    near = {x.sample_id: x["count"] for x in dg.duplicate_pairs(copies).groupBy("sample_id").count().collect()}
    assert near and {x.sample_id: x.dups for x in dg.ranked_duplicates(r, k).collect()} == near
