"""Blocked text index, pivot index and cosine self-join against brute force, with one key holding much of the data."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnwise.operators import blocked, cosine_join, lanes as ln, pivots


def texts(seed, n, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 12, 60]))) for _ in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("DOC_BLOCK", 40), ("QUERY_BLOCK", 3), ("RANGE", 4)):
        monkeypatch.setattr(blocked, name, value)
    monkeypatch.setattr(blocked.block_pairs, "__defaults__", (3, 40))


def frames(spark):
    """One scope with most records, a small one, one without records."""
    docs = [("hot" if i % 10 else "cold", f"d{i:03}", t) for i, t in enumerate(texts(1, 240))] + [("hot", "empty", ""), ("hot", "none", None)]
    queries = [(f"q{i}", ["hot", "cold", "bare"][i % 3], t) for i, t in enumerate(texts(2, 12))] + [("blank", "hot", "")]
    return (queries, docs, spark.createDataFrame(queries, "sample_id string, conversation_id string, query_text string"),
            spark.createDataFrame(docs, "conversation_id string, raw_id string, text string"))


def bm25(queries, docs, k1=1.2, b=0.75):
    out = {}
    for q, scope, text in queries:
        own = [(r, (t or "").split()) for s, r, t in docs if s == scope]
        avg = max(1.0, sum(len(t) for _, t in own) / max(1, len(own)))
        scores = {}
        for r, t in own:
            s = 0
            for term in text.split():
                df = sum(term in u for _, u in own)
                if term in t:
                    s += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * t.count(term) * (k1 + 1) / (t.count(term) + k1 * (1 - b + b * len(t) / avg))
            if s:
                scores[r] = round(s, 6)
        out[q] = scores
    return out


def test_blocks_give_the_best_records_exactly(spark, small_blocks):
    queries, docs, q, d = frames(spark)
    want = bm25(queries, docs)
    got = {}
    for r in ln.bm25(q, d, depth=7, profile="space").collect():
        got.setdefault(r.sample_id, []).append((r["rank"], r.raw_id, r.score))
    for name, scope, _ in queries:
        own = sorted(r for s, r, _ in docs if s == scope)
        best = sorted(own, key=lambda r: (-want[name].get(r, 0), r))[:7]
        assert [r for _, r, _ in sorted(got.get(name, []))] == best, name
        assert [round(s, 5) for _, _, s in sorted(got.get(name, []))] == [round(want[name].get(r, 0), 5) for r in best]


def test_rows_of_the_search_follow_blocks_not_pairs(spark, small_blocks):
    queries, docs, q, d = frames(spark)
    asked = blocked.asked_terms(q, "space")
    bags = blocked.record_bags(d, asked, "space")
    weights = blocked.weighted_queries(asked.select("*", F.lit(1.0).alias("w"), F.lit(1.0).alias("avg_len")))
    top = blocked.top_records(weights, bags, 2, lambda tf, dl, avg: np.ones(len(tf)))
    pairs = sum(1 for _, s, t in queries for u, _, x in docs if s == u and set(t.split()) & set((x or "").split()))
    blocks = {"hot": math.ceil(218 / 40), "cold": 1}
    assert top.count() <= 2 * sum(blocks.get(s, 0) for _, s, _ in queries) < pairs / 5


def test_ranges_are_skipped():
    rng = np.random.default_rng(0)
    n = 4096
    dl = rng.integers(1, 2000, n).astype(float)
    block = blocked.Block(np.arange(n), np.arange(n), dl, np.zeros(n, np.int64), np.ones(n), np.zeros(1, np.int64), lambda tf, length: tf / (1 + length))
    found, score, visited = block.best(np.zeros(1, int), np.ones(1), 128, False)
    assert visited <= 8 and set(np.argsort(dl)[:100]) <= set(found)


def test_records_of_several_texts_count_by_their_best(spark, small_blocks):
    docs = [("s", "r1", "a1", "x y"), ("s", "r1", "a2", "x"), ("s", "r2", "a3", "x y z"), ("s", "r3", "a4", "k")]
    d = spark.createDataFrame(docs, "conversation_id string, raw_id string, doc_id string, text string")
    q = spark.createDataFrame([("q", "s", "x")], "sample_id string, conversation_id string, query_text string")
    top = {r.raw_id: r.doc_id for r in ln.bm25_top(q, d, 2, profile="space").collect()}
    assert top == {"r1": "a2", "r2": "a3"}


def vectors(seed, n, width=12, groups=30, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, width))
    return centre[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, width))


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in (("CELL", 20), ("PART", 50), ("WARM", 30)):
        monkeypatch.setattr(pivots, name, value)


def test_pivots_find_the_nearest_records_and_skip_cells(spark, small_cells):
    v = vectors(3, 1500)
    # one record holds a third of all vectors
    rows = [("hot" if i % 20 else "cold", "big" if i % 3 == 0 else f"r{i:04}", v[i].tolist()) for i in range(len(v))] + [("hot", "zero", [0.0] * 12)]
    asked = [(f"q{i}", ["hot", "cold", "bare"][i % 3], x.tolist()) for i, x in enumerate(vectors(3, 9, noise=0.1))] + [("null", "hot", [0.0] * 12)]
    d = spark.createDataFrame(rows, "conversation_id string, raw_id string, vec array<double>")
    q = spark.createDataFrame(asked, "sample_id string, conversation_id string, vec array<double>")
    unit = lambda x: np.asarray(x) / max(np.linalg.norm(x), 1e-8)
    got = {}
    for r in ln.dense_lane(q, d, "x", 9).orderBy("rank").collect():
        got.setdefault(r.sample_id, []).append((r.raw_id, r.score))
    for name, scope, x in asked:
        best = {}
        for s, r, y in rows:
            if s == scope:
                best[r] = max(best.get(r, -2), round(float(unit(x) @ unit(y)), 6) + 0.0)
        want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:9]
        assert [r for r, _ in got.get(name, [])] == [r for r, _ in want], name
    share = {r.conversation_id: r.visited / r.pairs for r in pivots.visit_share(q.where("sample_id <> 'null'"), d, 9).collect()}
    assert share["hot"] < 0.5, share


def test_a_record_with_very_many_vectors(spark):
    n = 100_000
    d = spark.range(n).select(F.lit("s").alias("conversation_id"), F.when(F.col("id") % 50 == 7, F.concat(F.lit("r"), F.col("id"))).otherwise("big").alias("raw_id"),
                              F.array(*[F.sin(F.col("id") * (k + 1) * 0.37) for k in range(8)]).alias("vec"))
    q = spark.createDataFrame([("q", "s", [1.0, 0.5, -0.2, 0.1, 0.0, 0.3, 0.2, -0.4])], "sample_id string, conversation_id string, vec array<double>")
    got = ln.dense_lane(q, d, "x", 20).orderBy("rank").collect()
    ids = np.arange(n)
    v = np.sin(ids[:, None] * (np.arange(8) + 1) * 0.37)
    x = np.array([1.0, 0.5, -0.2, 0.1, 0.0, 0.3, 0.2, -0.4])
    s = v @ x / np.maximum(np.linalg.norm(v, axis=1), 1e-8) / np.linalg.norm(x)
    best = {}
    for i in ids:
        name = f"r{i}" if i % 50 == 7 else "big"
        best[name] = max(best.get(name, -2), s[i])
    assert [r.raw_id for r in got] == sorted(best, key=lambda r: (-round(best[r], 6), r))[:20]


def test_prefix_filter_keeps_every_pair():
    v = vectors(5, 300)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j, whole = cosine_join.prefix_pairs(u, u, 0.85)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(u @ u.T > 0.85)))) and whole < 300 * 300 / 2


def test_redundancy_equals_brute_force(spark, small_cells):
    v = vectors(7, 160)
    rows = [("hot", f"t{i % 40}", v[i % 120].tolist()) for i in range(160)] + [("hot", "same", [1.0] * 12)] * 60 + [("hot", "", [1.0] * 12), ("hot", None, None), ("hot", "t1", None), ("hot", "t1", [0.0] * 12)]
    rows += [("one", "a", [1.0] * 12), ("two", "b", None), ("two", "B", None), ("two", "c", [0.0] * 12)]
    got = {r.sample_id: (r.n, r.duplicates, r.RDR) for r in cosine_join.redundancy(spark.createDataFrame(rows, "sample_id string, text string, vec array<double>")).collect()}
    for sample in ("hot", "one", "two"):
        own = [((t or "").lower(), np.array(x) if x is not None and any(x) else None) for s, t, x in rows if s == sample]
        same = 0
        for a in range(len(own)):
            for b in range(a):
                (t, x), (u, y) = own[a], own[b]
                if t and u and (t == u or x is not None and y is not None and x @ y / np.linalg.norm(x) / np.linalg.norm(y) > 0.85):
                    same += 1
        assert got[sample][:2] == (len(own), same), sample


def test_scoped_cross_takes_any_scorer_and_lists_no_pairs(spark, small_blocks):
    from turnwise.operators import joins
    docs = [("hot" if i % 10 else "cold", f"d{i:03}", float(i * 37 % 101)) for i in range(300)]
    asked = [(f"q{i}", ["hot", "cold", "bare"][i % 3], float(i * 11)) for i in range(9)]
    d = spark.createDataFrame(docs, "conversation_id string, raw_id string, x double")
    q = spark.createDataFrame(asked, "sample_id string, conversation_id string, y double")
    near = lambda a, b: -np.abs(a["y"].to_numpy()[:, None] - b["x"].to_numpy()[None])
    got = {}
    for r in joins.scoped_cross(q, d, near, 4).orderBy("rank").collect():
        got.setdefault(r.sample_id, []).append((r.raw_id, r.score, r.n_candidates))
    for name, scope, y in asked:
        own = sorted(((r, -abs(y - x)) for s, r, x in docs if s == scope), key=lambda t: (-t[1], t[0]))
        assert got.get(name, []) == [(r, x, len(own)) for r, x in own[:4]]
    with pytest.raises(Exception, match="scorer gave"):
        joins.scoped_cross(q, d, lambda a, b: [0.0], 4).collect()


def test_terms_are_counted_a_bounded_number_at_a_time():
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(1)
    lists = [None if i % 50 == 7 else rng.integers(0, 90, 0 if i % 50 == 8 else 600).tolist() for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(lists, pa.list_(pa.int64()))], ["id", "_t"])
    count = blocked._count(b"\xff" * (blocked.FILTER_BITS // 8), True)
    tracemalloc.start()
    rows = 0
    for part in count(iter([batch])):
        for r in part.slice(0, 12).to_pylist():
            held = lists[r["id"]] or []
            want = {w: held.count(w) for w in held}
            assert r["dl"] == len(held) and dict(zip(r["terms"], r["tfs"])) == want == dict(zip(r["every"], r["counts"]))
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 60 << 20, peak  # 2.3 million terms
