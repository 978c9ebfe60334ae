"""What the stages of the pipeline move where their small sides are beyond a broadcast."""
import random

from moved import moved
from turnwise.llm import rules


def test_kept_texts_are_not_shuffled(spark, frame):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    docs = frame([(i, " ".join(rng.choices(words, k=400)) if i % 5 else "short") for i in range(600)]).localCheckpoint()
    texts = sum(len(r["text"]) for r in docs.collect())
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (size, _, _), rows = moved(spark, lambda: rules.accepted(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(rows) == 480 and all(r["doc_id"] % 5 for r in rows)
    assert size < 0.3 * texts
