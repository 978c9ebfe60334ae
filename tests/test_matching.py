"""Matching joins against brute force on small random texts."""
import random

from pyspark.sql import functions as F

from turnwise.operators import joins, matching


def texts(rng, n, alphabet="ab", longest=7):
    return [" ".join("".join(rng.choices(alphabet, k=rng.randint(1, 3))) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_gram_pairs_finds_every_containment(spark):
    rng = random.Random(2)
    words = lambda k, top: list({"".join(rng.choices("abc", k=rng.randint(0, top))) for _ in range(k)})
    needles, strings = words(40, 9), words(60, 20)
    n = spark.createDataFrame([("s", x) for x in needles], "k string, needle string")
    s = spark.createDataFrame([("s", x) for x in strings], "k string, string string")
    got = {(r.needle, r.string) for r in matching.gram_pairs(n, s, ["k"]).collect()}
    assert got == {(a, b) for a in needles for b in strings if a in b}


def test_contains_pairs_equals_brute_force(spark):
    rng = random.Random(4)
    a, b = texts(rng, 60, longest=4), texts(rng, 60, longest=9)
    n = spark.createDataFrame([("s", i, x) for i, x in enumerate(a)], "k string, nid int, nt string")
    h = spark.createDataFrame([("s", i, x) for i, x in enumerate(b)], "k string, hid int, ht string")
    got = {(r.nid, r.hid) for r in matching.contains_pairs(n, h, ["k"], "nid", "hid").collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x in y}


def test_overlap_pairs_equals_brute_force(spark):
    rng = random.Random(6)
    a, b = [rng.choices("abcdefgh", k=rng.randint(1, 8)) for _ in range(40)], [rng.choices("abcdefgh", k=rng.randint(1, 8)) for _ in range(40)]
    L = spark.createDataFrame([("s", i, x) for i, x in enumerate(a)], "k string, l int, lw array<string>")
    R = spark.createDataFrame([("s", i, x) for i, x in enumerate(b)], "k string, r int, rw array<string>")
    share = lambda x, y: len(set(x) & set(y)) / len(set(x))
    for ratio, strict in ((0.85, False), (0.5, False), (0.15, True), (0.5, True)):
        got = {(r.l, r.r) for r in matching.overlap_pairs(L, R, ["k"], "l", "r", ratio, strict).collect()}
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if set(x) & set(y) and (share(x, y) > ratio if strict else share(x, y) >= ratio)}
        assert got == want, (ratio, strict)


def test_explicit_ids_in_order_of_mention(spark):
    turns = spark.createDataFrame([("c", 0, "D1:1", "session_1"), ("c", 1, "D1:2", "session_1")], "conversation_id string, pos int, turn_id string, session_id string")
    t = spark.createDataFrame([("t", "c", "see session_1 and D1:2; source_ids: D1:1, D9:9]")], "text_id string, conversation_id string, text string")
    got = [r.source_id for r in joins.explicit_ids(t, turns).orderBy("o").collect()]
    assert got == ["session_1", "D1:2", "D1:1"]


def test_trace_gold_baselines(spark):
    rows = [("s", sys, ["D1:1", "D1:2"], ["x"], ["D1:1"], ["D1:1"]) for sys in ("no_memory", "full_context", "mem")]
    df = spark.createDataFrame(rows, "sample_id string, system string, gold_ids array<string>, retrieved_ids array<string>, injected_ids array<string>, known_ids array<string>")
    got = {r.system: (r.retrieved_gold_ids, r.prompt_gold_ids) for r in joins.trace_gold(df).collect()}
    assert got == {"no_memory": ([], []), "full_context": (["d1:1"], ["d1:1"]), "mem": ([], ["d1:1"])}


def test_trace_prompt_matches_contents_and_blocks_in_one_go(spark, monkeypatch):
    calls, real = [], joins.infer_sources
    monkeypatch.setattr(joins, "infer_sources", lambda texts, turns: calls.append(1) or real(texts, turns))
    turns = spark.createDataFrame([("c", 0, "D1:1", "session_1", "red apples grow here", "2023-01-01"), ("c", 1, "D1:2", "session_1", "blue pears fall there", "2023-01-01")],
                                  "conversation_id string, pos long, turn_id string, session_id string, text string, timestamp string")
    prompts = spark.createDataFrame([("s", "c", 1, "e")], "sample_id string, conversation_id string, place long, entry_id string")
    entries = spark.createDataFrame([("e", "red apples grow here", [])], "entry_id string, content string, source_ids array<string>")
    got = spark.createDataFrame([("s", "e", "red apples grow here", [], "", None)], "sample_id string, entry_id string, content string, source_ids array<string>, query string, batch_ids array<string>")
    blocks = spark.createDataFrame([("s", "c", "red apples grow here\nblue pears fall there")], "sample_id string, conversation_id string, text string")
    rows = joins.trace_prompt(prompts, entries, got, turns, blocks).orderBy("rank").collect()
    assert [r.source_id for r in rows] == ["e", "D1:1", "session_1", "D1:2"] and len(calls) == 1


def _text_turns(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice(["ye", "yes", "eyes", "ab", "abc", "cab", "bye", "my", "oh"]) for _ in range(n))
    t = [(s, f"{s}{i}", words(rng.choice([1, 1, 2, 5]))) for s in "cd" for i in range(25)] + [("c", "none", ""), ("e", "alone", "ye")]
    u = [(s, i, words(rng.choice([1, 4, 6]))) for s in "cd" for i in range(20)] + [("c", 99, " ")]
    texts = spark.createDataFrame(t, "conversation_id string, text_id string, text string")
    turns = spark.createDataFrame(u, "conversation_id string, pos int, text string")
    share = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()))
    want = {(i, p) for s, i, a in t for z, p, b in u if s == z and a.strip() and b.strip() and (a in b or b in a or share(b, a) >= 0.85)}
    return texts, turns, want


def test_text_turn_pairs_of_bounded_scopes_meet_once(spark, monkeypatch):
    texts, turns, want = _text_turns(spark)

    def spread(*_):
        raise AssertionError("words of a small scope were spread out")

    monkeypatch.setattr(joins, "contains_pairs", spread)
    monkeypatch.setattr(joins, "overlap_pairs", spread)
    got = [(r.text_id, r.pos) for r in joins.text_turn_pairs(texts, turns).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_text_turn_pairs_of_large_scopes_are_the_same(spark, monkeypatch):
    texts, turns, want = _text_turns(spark)
    turns = turns.where("conversation_id <> 'd' or pos < 10")  # 250 pairs in d, 500 in c
    want = {(t, p) for t, p in want if not t.startswith("d") or p < 10}
    for bound in (1, 300):
        monkeypatch.setattr(joins, "DIRECT_PAIRS", bound)
        assert {(r.text_id, r.pos) for r in joins.text_turn_pairs(texts, turns).collect()} == want, bound
