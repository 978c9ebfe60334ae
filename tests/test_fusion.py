"""Greedy selection against independent step-by-step versions."""
import random

from turnwise.operators import fusion


def slow_quota(lanes, amounts, order, limit):
    out = []
    for name, n in amounts:
        added = 0
        for rid in lanes.get(name, []):
            if added == n or len(out) == limit:
                break
            if rid not in out:
                out.append(rid)
                added += 1
    moved = True
    while len(out) < limit and moved:
        moved = False
        for name in order:
            for rid in lanes.get(name, []):
                if rid not in out:
                    if len(out) < limit:
                        out.append(rid)
                        moved = True
                    break
    return out


def test_quota_fold_equals_steps(spark):
    rng, rows, want = random.Random(1), [], {}
    spec = {arm: [(n, rng.randint(1, 6)) for n in fusion.LANE_ORDER] for arm in ("A", "B")}
    for q in range(60):
        ids = [f"r{i}" for i in range(rng.randint(1, 30))]
        lanes = {n: rng.sample(ids, rng.randint(0, len(ids))) for n in fusion.LANE_ORDER}
        rows += [(f"q{q}", n, r, i + 1) for n, rs in lanes.items() for i, r in enumerate(rs)]
        for arm, amounts in spec.items():
            want[f"q{q}", arm] = slow_quota(lanes, amounts, fusion.LANE_ORDER, 13)
    got = {}
    for r in fusion.quota_fill(spark.createDataFrame(rows, "sample_id string, lane string, raw_id string, rank int"), spec, limit=13).orderBy("rank").collect():
        got.setdefault((r.sample_id, r.arm), []).append(r.raw_id)
    assert got == {k: v for k, v in want.items() if v}


def test_route_keeps_core_quota_closure_and_fills():
    cfg = {"core": 2, "core_support": 2, "default": (2, 1, 1), "set": (1, 1, 1), "closure": 1}
    layers = [["a", "b", "c", "d"], ["b", "e", "f"], ["g", "b"]]
    agreed = [("b", 3), ("a", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 1), ("g", 1)]
    links = [("b", "z", True, 3), ("b", "f", False, 1), ("q", "y", True, 1)]
    got = fusion.route("SINGLE_FACT", layers, agreed, links, ["a", "b", "c", "d", "e", "f", "g"], cfg, 8)
    # core b, then two of layer 1, one of layer 2 and 3, the necessary neighbour, then completion
    assert got == ["b", "a", "c", "e", "g", "z", "f", "d"] or got[:5] == ["b", "a", "c", "e", "g"]
    assert len(got) == len(set(got)) == 8 and "z" in got and "y" not in got


def test_layer_collapse_puts_worse_ranks_first_on_equal_support(spark):
    df = spark.createDataFrame([("s", 1, "x", "a", 1), ("s", 1, "x", "b", 9), ("s", 1, "y", "c", 5), ("s", 1, "x", "c", 7)], "sample_id string, layer int, stream string, raw_id string, rank int")
    order = lambda **k: [r.raw_id for r in fusion.layer_collapse(df, **k).orderBy("rank").collect()]
    assert order() == ["c", "b", "a"]
    assert order(worse_first=False) == ["c", "a", "b"]


def test_rrf_arms_of_one_record(spark):
    df = spark.createDataFrame([("s", "f1", "a", 1), ("s", "f2", "a", 2)], "sample_id string, family string, raw_id string, rank int")
    got = {r.arm: r.score for r in fusion.fuse(df).collect()}
    x, y = 1 / 21, 1 / 22
    assert abs(got["RRF_BASELINE"] - (x + y)) < 1e-9 and abs(got["COMBMAX"] - x) < 1e-9
    assert abs(got["SHARP_RRF_P2"] - (x * x + y * y)) < 1e-9 and abs(got["BEST_PRIMARY_L025"] - (x + 0.25 * y)) < 1e-9


def test_packet_budget_and_prefixes(spark):
    top = spark.createDataFrame([("s", "r1", 1), ("s", "r2", 2)], "sample_id string, raw_id string, rank int")
    raws = spark.createDataFrame([("r1", "u", "t", "abcdef", None), ("r2", "u", "t", "ab", "cap")], "raw_id string, speaker string, timestamp string, raw_text string, image_caption string")
    facts = spark.createDataFrame([("r1", 2, "two"), ("r1", 1, "one")], "raw_id string, ord int, retrieval_text string")
    got = {r.raw_id: r for r in fusion.packet(top, raws, facts, 3).collect()}
    assert got["r1"].original_text.startswith("abc\n[") and got["r1"].memory_assertions == "one\ntwo" and got["r2"].image_caption == "cap"
    assert sorted((r.k, r.raw_id) for r in fusion.prefix(top, (1, 2)).collect()) == [(1, "r1"), (2, "r1"), (2, "r2")]
