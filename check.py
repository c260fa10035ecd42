"""Run registered queries against their DuckDB twins on one input folder.

    python check.py [--dir DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

import taxaspark.catalog as catalog
from taxaspark.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--partitions", type=int, default=8)
    args = parser.parse_args()
    queries, oracles = catalog.load()
    picked = [n for n in queries if not args.names or any(n == a or n.startswith(a + "_") or n.startswith(a) for a in args.names)]
    spark = build_session("check", "8", args.partitions)
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{args.dir}/{t}.parquet"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{args.dir}/{t}.parquet'")
    bad = 0
    for name in picked:
        start = time.time()
        try:
            df = queries[name](spark, args.dir)
            got_cols, got = df.columns, [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS  {name:32s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            start = time.time()
            rel = duck.sql(oracles[name])
            want_cols, want = rel.columns, rel.fetchall()
            duck_took = time.time() - start
            a, b = rows_of(got_cols, got), rows_of(want_cols, want)
            ok = sorted(got_cols) == sorted(want_cols) and a == b
            print(f"{'OK   ' if ok else 'DIFF '} {name:32s} {len(got):7d} rows {took:6.2f}s duck {duck_took:5.2f}s", flush=True)
            if not ok:
                bad += 1
                print("   columns", sorted(got_cols), sorted(want_cols), "rows", len(a), len(b))
                left, right = set(a) - set(b), set(b) - set(a)
                for side, only in (("spark", left), ("duck ", right)):
                    for r in sorted(only)[:3]:
                        print("  ", side, r)
        except Exception as exc:  # a failing query must not hide the others
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print(f"{len(picked)} queries, {bad} not matching")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
