"""Run registered queries against their DuckDB twins: compare.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("compare")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, oracle, sf_dir):
    t0 = time.time()
    df = build(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if oracle is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    cur = con.execute(oracle)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    t2 = time.time()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}", t1 - t0, t2 - t1
    if got == want:
        return f"ok {len(got)}", t1 - t0, t2 - t1
    only_got, only_want = Counter(got) - Counter(want), Counter(want) - Counter(got)
    key = lambda r: repr(r[::-1])
    left, right = sorted(only_got, key=key)[:3], sorted(only_want, key=key)[:3]
    return (
        f"DIFF spark={len(got)} duckdb={len(want)} differing={sum(only_got.values())}\n   cols={sorted(cols)}"
        + "".join(f"\n   S {g}" for g in left) + "".join(f"\n   D {w}" for w in right),
        t1 - t0, t2 - t1,
    )


def main(argv):
    from gaugeflow.plans import load_queries

    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in load_queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            verdict, a, b = compare(spark, con, name, q.build, q.oracle, sf_dir)
        except Exception as exc:  # report and go on
            verdict, a, b = f"ERROR {str(exc)[:1500]}", 0.0, 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:28s} spark {a:6.2f}s duckdb {b:6.2f}s  {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
