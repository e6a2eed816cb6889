"""Spark query vs DuckDB oracle: row count, column names and order-insensitive values."""
from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not problems:
        from collections import Counter

        a, b = Counter(rows_of(scols, srows)), Counter(rows_of(dcols, drows))
        only_s, only_d = list((a - b).elements()), list((b - a).elements())
        if only_s or only_d:
            problems.append(f"{len(only_s)} rows differ; spark-only {sorted(only_s, key=repr)[:2]} duck-only {sorted(only_d, key=repr)[:2]}")
    return problems


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from kreditflow.catalog import oracle_sql, queries
    from kreditflow.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(os.environ.get("MASTER", "local[8]"), shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        sql = os_.get(name)
        if sql is None:
            n = fn(spark, sf_dir).count()
            print(f"NOSQL {name} rows={n}", flush=True)
            continue
        try:
            p = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            p = [f"ERROR {type(e).__name__}: {str(e)[:400]}"]
        print(("OK   " if not p else "FAIL ") + name + ("" if not p else " :: " + " | ".join(p)), flush=True)
        bad += bool(p)
    print("failed", bad)
