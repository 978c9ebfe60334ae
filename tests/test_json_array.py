"""The splittable array reader: elements across many byte ranges, wrappers, odd strings."""
import json
import random

import pytest
from turnwise.sources.json_array import base_depth, read_array


def element(rng, i):
    odd = rng.choice(['plain', 'a "quoted" } , {', 'back\\slash\\', '[,]', 'é  ', '\\"', ''])
    return {"id": i, "text": odd * rng.randint(0, 4), "deep": [{"x": [1, {"y": "}"}]}] * rng.randint(0, 3), odd or "k": None}


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, was[k]) if k in was else spark.conf.unset(k)


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_across_ranges(spark, tmp_path, small_splits, indent):
    rng = random.Random(2)
    rows = [element(rng, i) for i in range(400)] + [{"id": 400, "text": "z}" * 6000}, {"id": 401}]
    text = json.dumps(rows, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text("﻿" + json.dumps({"records": rows[:200], "meta": {"n": [1, {"z": 2}]}}, indent=indent), encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('[\n {"id": 1}\n]\n')
    got = [json.loads(r.value) for r in read_array(spark, str(tmp_path)).collect()]
    want = rows + rows[:200] + [{"id": 1}]
    assert sorted(json.dumps(x, sort_keys=True) for x in got) == sorted(json.dumps(x, sort_keys=True) for x in want)


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path):
    """200 MB in one array."""
    path, n, body = tmp_path / "big.json", 200_000, "w" * 980
    with open(path, "w") as f:
        f.write("[")
        for i in range(n):
            f.write(("," if i else "") + f'{{"id":{i},"text":"{body}"}}')
        f.write("]")
    assert path.stat().st_size > 200_000_000
    rows = read_array(spark, str(path))
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() >= 2
    from pyspark.sql import functions as F
    r = rows.agg(F.count("*"), F.max(F.length("value")), F.countDistinct(F.get_json_object("value", "$.id"))).first()
    assert tuple(r) == (n, len(f'{{"id":{n - 1},"text":"{body}"}}'), n)


def test_base_depth():
    assert [base_depth(h) for h in ("[1", ' {"samples" : [', '{"x":[', "", "﻿[")] == [1, 2, 0, 0, 1]
