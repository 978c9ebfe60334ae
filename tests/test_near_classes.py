"""Near texts are found between classes of equal word sets; copies are counted, not compared."""
import itertools
import random

from turnwise.operators import diagnostics as dg


def test_counts_and_pairs_with_copies(spark):
    rng = random.Random(5)
    base = [rng.sample([f"w{i}" for i in range(60)], rng.randint(1, 30)) for _ in range(12)]
    vary = lambda x: [*x[:-1], "new"] if rng.random() < 0.5 else [*x, "more"]
    texts = [" ".join(rng.sample(y, len(y))) for x in base for y in (x, x, vary(x), vary(x))] + ["", "w1"] * 2
    rows = [(s, f"{s}{i:03d}", x) for s in "ab" for i, x in enumerate(texts) if s == "a" or i % 3] + [(None, "n1", "w1"), (None, "n2", "w1")]
    df = spark.createDataFrame(rows, "sample_id string, text_id string, text string")
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / max(1, len(set(x.split()) | set(y.split())))
    for ratio in (0.85, 0.5):
        want = {(s, i, j) for (s, i, x), (z, j, y) in itertools.combinations(rows, 2) if s == z and s and jac(x, y) > ratio}
        got = [tuple(r) for r in dg.duplicate_pairs(df, ratio=ratio).select("sample_id", "text_id", "other_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r.sample_id: r.dups for r in dg.duplicate_counts(df, ratio=ratio).collect()} == {s: sum(w[0] == s for w in want) for s in "ab"}


def test_copies_and_unlike_texts_are_not_compared(spark):
    rows = [("s", f"c{i:03d}", "the same words again and again") for i in range(300)] + [("s", f"u{i}", f"the word{i} other{i} thing{i} again") for i in range(100)]
    df = spark.createDataFrame(rows, "sample_id string, text_id string, text string")
    _, classes, near = dg.near_classes(df)
    assert classes.count() == 101 and near.count() == 0
    assert [(r.sample_id, r.dups) for r in dg.duplicate_counts(df).collect()] == [("s", 300 * 299 // 2)]
