"""The bounded fuzzy decision against the ratio itself."""
import random
from collections import Counter
from difflib import SequenceMatcher

from turnwise.functions import python_udfs as pu
from turnwise.operators import diagnostics as dg


def grams(s):
    return Counter(zip(s, s[1:]))


def changed(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s))
        s[at:at + rng.randrange(2)] = rng.choice("abcde ") * rng.randrange(3)
        s = s or ["a"]
    return "".join(s)


def test_decision_is_the_ratio():
    rng, seen = random.Random(5), Counter()
    for _ in range(4000):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 90)))
        b = changed(rng, a, rng.randrange(12))
        for least in (0.9, 0.92):
            want = SequenceMatcher(None, a, b).ratio() >= least
            assert pu.reaches(a, b, least, grams) == want
            seen[want] += 1
    assert min(seen.values()) > 500


def test_unlike_texts_are_turned_down_without_the_ratio(monkeypatch):
    rng, asked = random.Random(6), []

    class Counted(SequenceMatcher):
        def ratio(self):
            asked.append(1)
            return super().ratio()
    monkeypatch.setattr(pu, "SequenceMatcher", Counted)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    assert not any(pu.reaches(a, b, 0.92, grams) for a in texts for b in texts if a != b)
    assert not asked


def test_fuzzy_rule_and_nulls(spark):
    rows = [(1, "alphabet soups", "alphabet soup"), (2, "alphabet soups", "nothing alike"), (3, None, "x"), (4, "colours gray", "colors gray")]
    got = {r.pair_id: r.rule for r in dg.evidence_in_text(spark.createDataFrame(rows, "pair_id int, unit string, text string")).collect()}
    assert got == {1: "fuzzy", 2: None, 3: "empty", 4: "fuzzy"}
