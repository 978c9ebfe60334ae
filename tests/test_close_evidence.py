"""Texts close to a unit are evidence too, in scopes of every size; the SQL says the same."""
import random
from difflib import SequenceMatcher

import duckdb
import pytest

from turnwise.operators import diagnostics as dg, joins
from turnwise.plans import PLANS


def _brute(units, texts, fuzzy):
    share = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()))
    return {(u, t) for s, u, a in units for z, t, b in texts if s == z and a and b and (a in b or share(a, b) >= 0.8 or (fuzzy and SequenceMatcher(None, a, b).ratio() >= fuzzy))}


@pytest.mark.parametrize("bound", [1 << 21, 1])
def test_close_texts_are_evidence(spark, monkeypatch, bound):
    monkeypatch.setattr(joins, "DIRECT_PAIRS", bound)
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))
    base = [words(rng.choice([1, 2, 4, 9])) for _ in range(25)] + [""]
    near = lambda x: "".join(rng.choice("xyz") if c != " " and rng.random() < 0.06 else c for c in x)
    units = [("s", f"u{i}", x) for i, x in enumerate(base)]
    texts = [("s", f"t{i}", near(x)) for i, x in enumerate(base)] + [("s", f"w{i}", f"{x} {words(2)}") for i, x in enumerate(base)] + [("z", "other", base[0])]
    u = spark.createDataFrame(units, "sample_id string, unit_id string, unit string")
    t = spark.createDataFrame(texts, "sample_id string, text_id string, text string")
    got = lambda fuzzy: [(r.unit_id, r.text_id) for r in dg.evidence_pairs(u, t, fuzzy=fuzzy).collect()]
    assert _brute(units, texts, 0.92) != _brute(units, texts, None)
    for fuzzy in (0.92, None):
        assert len(got(fuzzy)) == len(set(got(fuzzy))) and set(got(fuzzy)) == _brute(units, texts, fuzzy), fuzzy


def test_query_finds_close_texts_as_its_sql(spark, tmp_path):
    rare = "".join(chr(0x4E00 + i) for i in range(150))
    texts = ["what did you plant there", "We planted the orchardtrees alongside thegarden.", "when", "we planted tho orchardtreas alongside thegarten",
             "and this", rare + "abc" * 25, "then", rare + "abc" * 24 + "abx", "last", "a" * 250 + "."]
    rows = [(0, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in PLANS["dg_evidence_in_text"](spark, str(tmp_path)).select("sample_id", "unit_id", "text_id").collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == set(con.execute(PLANS["dg_evidence_in_text"].sql).fetchall())
    assert ("0::D1:1", "u1", "0::D1:4") in got and ("0::D2:1", "u1", "0::D2:4") in got


def test_wide_scopes_match_only_what_is_ranked(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices("abcdefghij", k=rng.randint(1, 5)))
    turns = [("c", f"t{i:02d}", text()) for i in range(40)] + [("d", f"u{i}", text()) for i in range(5)]
    rank = [(f"s{q}", f"t{i:02d}") for q in range(6) for i in rng.sample(range(40), 8)] + [("z", f"u{i}") for i in range(5)]
    units = [(f"s{q}", "c", f"n{i}", text()) for q in range(6) for i in range(3)] + [("z", "d", "n0", "a b")]
    r = spark.createDataFrame(turns, "conversation_id string, text_id string, text string")
    k = spark.createDataFrame(rank, "sample_id string, text_id string")
    u = spark.createDataFrame(units, "sample_id string, conversation_id string, unit_id string, unit string")
    met, real = [], dg._pairs_met
    monkeypatch.setattr(dg, "_pairs_met", lambda u, t, *a: met.append(u.join(t, list(a[0])).count()) or real(u, t, *a))
    found = lambda: {tuple(x) for x in dg.ranked_evidence_pairs(u, r, k).collect()}
    want, whole = found(), sum(met)
    monkeypatch.setattr(dg, "WIDE", 10)
    met.clear()
    assert want and found() == want and sum(met) == 6 * 3 * 8 + 5 < whole
