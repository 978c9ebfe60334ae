"""Plan-shape helpers against plain Python, with block sizes small enough to matter."""
import random

from pyspark.sql import functions as F

from turnwise.operators import corpus, lanes, packing, scale


def test_ordinal_numbers_across_blocks(spark):
    rng = random.Random(1)
    rows = [(k, p) for k in ("a", "b") for p in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, p int")
    got = {(r.k, r.p): r.rn for r in scale.ordinal(df, ["k"], ["p"], F.floor(F.col("p") / 7)).collect()}
    for k in ("a", "b"):
        for i, p in enumerate(sorted(p for kk, p in rows if kk == k), 1):
            assert got[k, p] == i


def test_salted_join_equals_broadcast_join(spark, monkeypatch):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "k long, n string")
    want = sorted(map(tuple, scale.keyed_join(big, small, ["k"], "v").collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(scale, "fits_broadcast", lambda *a, **k: False)
    assert sorted(map(tuple, scale.keyed_join(big, small, ["k"], "v").collect())) == want


def test_neighbors_over_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 3)
    df = spark.createDataFrame([("c", i, f"t{i}") for i in range(11)] + [("d", 0, "x")], "c string, pos int, t string")
    got = {(r.c, r.pos): [x.t for x in r.context] for r in corpus.neighbors(df, ["c"], "pos", 3, 2, ["t"]).collect()}
    for i in range(11):
        assert got["c", i] == [f"t{j}" for j in range(max(0, i - 3), min(11, i + 3)) if j != i]
    assert got["d", 0] == []


def test_previous_keeps_columns(spark):
    df = spark.createDataFrame([("c", 0, "a"), ("c", 1, "b")], "c string, pos int, t string")
    assert sorted((r.t, r.prev_t) for r in corpus.previous(df, ["c"], "pos", ["t"]).collect()) == [("a", None), ("b", "a")]


def test_supersede_matches_a_sequential_walk(spark):
    rng = random.Random(3)
    rows = [("c", rng.choice("st"), "r", rng.choice("xyz"), f"{d:03d}", i, f"a{i}") for i, d in enumerate(rng.choices(range(40), k=80))]
    df = spark.createDataFrame(rows, "conversation_id string, subject string, relation string, value string, timestamp string, ord int, assertion_id string").withColumn("session_id", F.lit("s")).withColumn("raw_id", F.lit("r"))
    got = {r.assertion_id: (r.status, r.superseded_by) for r in corpus.supersede(df, block=F.substring("timestamp", 1, 2)).collect()}
    want, last = {}, {}
    for c, s, r, v, t, o, a in sorted(rows, key=lambda x: (x[4], x[5])):
        want[a] = ("CURRENT", None)
        if s in last and last[s][0] != v:
            want[last[s][1]] = ("SUPERSEDED", a)
        last[s] = (v, a)
    assert got == want


def greedy(costs, budget):
    out, n, load = [], 0, 0
    for c in costs:
        if load > 0 and load + c > budget:
            n, load = n + 1, 0
        load += c
        out.append(n)
    return out


def test_run_outcomes_for_every_entering_load():
    rng = random.Random(5)
    for _ in range(300):
        budget = rng.randint(1, 12)
        costs = [rng.choice([0, 0, 1, 2, 3, 5, 15]) for _ in range(rng.randint(1, 9))]
        empty, steps = packing.run_outcomes(costs, budget)
        for load in range(0, 30):
            n, cur = 0, load
            for c in costs:
                if cur > 0 and cur + c > budget:
                    n, cur = n + 1, 0
                cur += c
            assert packing.enter_run(load, empty, steps, sum(costs)) == (cur, n), (costs, budget, load)


def test_pack_over_short_runs_equals_one_walk(spark):
    rng = random.Random(7)
    data = {k: [rng.choice([0, 1, 2, 4, 9, 30]) for _ in range(57)] for k in ("a", "b")}
    df = spark.createDataFrame([(k, i, c) for k, cs in data.items() for i, c in enumerate(cs)], "k string, pos int, c int")
    got = packing.pack(df, ["k"], "pos", F.col("c"), 11, run=4).collect()
    for k, cs in data.items():
        assert [r.chunk for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)] == greedy(cs, 11)


def test_pack_keeps_runs_whole_where_rows_of_a_key_lie_far_apart(spark):
    # an RDD has no size estimate: the planner first sorts and merges, then finds that the runs' summaries fit a broadcast
    rng = random.Random(11)
    data = {f"k{k}": [rng.choice([1, 2, 4, 9, 30]) for _ in range(40)] for k in range(20)}
    rows = [(k, i, c) for k, cs in data.items() for i, c in enumerate(cs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "k string, pos long, c long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack(df, ["k"], "pos", F.col("c"), 11, run=16).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for k, cs in data.items():
        assert [r.chunk for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)] == greedy(cs, 11)


def test_vector_blocks_of_tiny_size_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lanes, "DOC_BLOCK", 3)
    monkeypatch.setattr(lanes, "QUERY_BLOCK", 2)
    rng = random.Random(9)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    docs = [(rng.choice("xy"), f"r{i % 11}", vec()) for i in range(40)]
    qs = [(f"q{i}", rng.choice("xy"), vec()) for i in range(7)]
    # a record belongs to one scope only
    docs = [(("x" if int(r[1:]) % 2 else "y"), r, v) for _, r, v in docs]
    D = spark.createDataFrame(docs, "conversation_id string, raw_id string, vec array<double>")
    Q = spark.createDataFrame(qs, "sample_id string, conversation_id string, vec array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = {}
    for sid, c, v in qs:
        best = {}
        for dc, r, w in docs:
            if dc == c:
                best[r] = max(best.get(r, -2), cos(v, w))
        for i, (r, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4], 1):
            want[sid, i] = (r, round(s, 6))
    got = {(r.sample_id, r["rank"]): (r.raw_id, r.score) for r in lanes.dense_lane(Q, D, "x", 4).collect()}
    assert got == want


def test_episode_lane_keeps_equal_session_numbers_of_scopes_apart(spark):
    # more scopes than a ranking is deep, all with sessions 1 and 2
    raws = spark.createDataFrame([(f"{c}::D{n}", str(c), n, n, "apple pear") for c in range(300) for n in (1, 2)], "raw_id string, conversation_id string, session_no int, pos long, text string")
    queries = raws.where("session_no = 2").select(F.col("raw_id").alias("sample_id"), "conversation_id", F.lit("apple").alias("query_text"))
    got = lanes.episode_lane(queries, raws).where("score > 0").groupBy("sample_id").count().collect()
    assert len(got) == 300 and all(r["count"] == 2 for r in got)


def test_keyed_join_makes_no_copies_that_outweigh_the_big_side(spark, monkeypatch):
    monkeypatch.setattr(scale, "fits_broadcast", lambda df, limit=0: False)
    big = spark.range(4000).selectExpr("id % 1000 as k", "id")
    peers, few = spark.range(1000).selectExpr("id as k", "id * 2 as v"), spark.range(10).selectExpr("id as k", "id * 2 as v")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for small, copied, rows in ((peers, False, 4000), (few, True, 40)):
        j = scale.keyed_join(big, small, ["k"], "id")
        assert ("_salt" in plan(j)) == copied
        assert {(r.k, r.id, r.v) for r in j.collect()} == {(i % 1000, i, i % 1000 * 2) for i in range(4000) if copied is False or i % 1000 < 10} and j.count() == rows
