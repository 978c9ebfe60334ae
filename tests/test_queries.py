"""Named queries against DuckDB on the smallest tables. ORACLE_ALL=1 runs every query."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import ROOT, compare, duck

QUICK = ["flow_bm25_recall", "ln_bm25", "ln_graph", "ln_dense_max", "ln_role_fact", "fus_rrf", "jn_text_contains", "jn_trace_retrieval", "agg_sample_metrics", "agg_retrieval_sweep",
         "dg_encoding", "cmp_assertions", "cmp_supersession", "cmp_pages", "ctr_shape_repair", "ctr_contextual", "win_latest_wins", "src_locomo", "txt_split_clauses", "snk_manifest"]
KEYS = list(entry.queries()) if os.environ.get("ORACLE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(f"{ROOT}/sf0.001")


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    status, n, detail = compare(spark, con, f"{ROOT}/sf0.001", key, entry.queries()[key], entry.oracle_sql().get(key))
    assert status in ("ok", "rows", "EMPTY"), (status, detail)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_word_edges_are_those_of_the_sql(spark, tmp_path):
    texts = ["ité va", "Noé part", "no, thanks", " yes indeed", "thiſ one", "we İt go", "ıt went", "itë", "say the_ it2 now", "éit", "righté", "who é?", "WHAT́ now you", "plain words here"]
    rows = [(c, i, "user", x) for c in range(3) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for key in ("txt_context_gate", "txt_context_needed"):
        status, n, detail = compare(spark, con, str(tmp_path), key, entry.queries()[key], entry.oracle_sql()[key])
        assert status == "ok" and n == len(rows), (key, detail)
