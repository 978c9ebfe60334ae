"""Run queries and their SQL side by side: python tests/oracle_check.py [sf] [key-prefix ...]"""
from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnwise.plans.registry import TABLES  # noqa: E402

ROOT = "/root/testdata"


def duck(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, path, key, query, sql):
    df = query(spark, path)
    cols, rows = spark_rows(df)
    if sql is None:
        return ("rows" if rows else "EMPTY"), len(rows), None
    dcols, drows = duck_rows(con, sql)
    if cols != dcols:
        return "COLUMNS", len(rows), (cols, dcols)
    if rows != drows:
        a, b = set(rows), set(drows)
        return "DIFF", len(rows), (len(rows), len(drows), sorted(a - b)[:2], sorted(b - a)[:2])
    return ("ok" if rows else "EMPTY"), len(rows), None


def main(argv):
    sf = argv[0] if argv else "sf0.001"
    import __spark_entry__ as entry
    from turnwise.session import local_session
    spark = local_session("oracle")
    path = f"{ROOT}/{sf}"
    con = duck(path)
    qs, sql = entry.queries(), entry.oracle_sql()
    picked = [k for k in qs if not argv[1:] or any(k.startswith(p) for p in argv[1:])]
    bad = []
    for k in picked:
        t = time.time()
        try:
            status, n, detail = compare(spark, con, path, k, qs[k], sql.get(k))
        except Exception as e:  # noqa: BLE001
            status, n, detail = "ERROR", 0, "".join(traceback.format_exception_only(e))[:1500]
        if status not in ("ok", "rows"):
            bad.append(k)
        print(f"{status:8} {k:28} {n:7} {time.time() - t:6.2f}s", flush=True)
        if detail:
            print("     ", str(detail)[:1800], flush=True)
    print(f"{len(picked) - len(bad)}/{len(picked)} fine; bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
