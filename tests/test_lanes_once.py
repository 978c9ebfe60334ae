"""The ranked lanes of orders: dealt once by sample, whatever is made of them, also for a customer with very many orders."""
import datetime
import random
from types import SimpleNamespace

from moved import moved
from turnwise.operators import fusion as fu
from turnwise.plans import bindings as b, fusion_plans as fp


def _orders(spark, path, rows):
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderdate date, o_orderpriority string").write.parquet(str(path))
    return SimpleNamespace(spark=spark, orders=spark.read.parquet(str(path)))


def _rows(n, customers, seed=5):
    rng = random.Random(seed)
    day = datetime.date(1995, 1, 1)
    return [(i, rng.randrange(customers), float(rng.randrange(50)), rng.choice("FOP") if i % 17 else None, day + datetime.timedelta(rng.randrange(300)), rng.choice(["1-A", "2-B"])) for i in range(n)]


def test_crowded_customers_rank_as_others(spark, tmp_path, monkeypatch):
    rows = _rows(900, 3)
    want = set()
    for c in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == c]
        for lane, key, takes in (("price_desc", lambda r: (-r[2], r[0]), lambda r: True), ("price_asc", lambda r: (r[2], r[0]), lambda r: r[3] not in (None, "P")),
                                 ("newest", lambda r: (-r[4].toordinal(), r[0]), lambda r: True), ("oldest", lambda r: (r[4], r[0]), lambda r: r[3] not in (None, "F")),
                                 ("priority", lambda r: (r[5], r[0]), lambda r: True)):
            want |= {(f"c{c}", lane, f"o{r[0]}", i) for i, r in enumerate(sorted(filter(takes, own), key=key)[:128], 1)}
    t = _orders(spark, tmp_path / "orders", rows)
    for crowd in (8192, 100):
        monkeypatch.setattr(b, "_CROWD", crowd)
        got = [(r.sample_id, r.lane, r.raw_id, r.rank) for r in b.lanes(t).collect()]
        assert len(got) == len(want) and set(got) == want


def test_orders_are_shuffled_once(spark, tmp_path):
    t = _orders(spark, tmp_path / "orders", _rows(3000, 300))
    for build in (lambda: fu.layer_collapse(fp._streams(t)), lambda: fu.consensus(fu.layer_collapse(fp._streams(t))), lambda: fu.fuse(fu.collapse_best(b.lanes(t)), arms=["RRF_BASELINE"])):
        (_, _, rows), out = moved(spark, lambda: build().collect())
        assert out and rows < 2 * 3000 + 1000
