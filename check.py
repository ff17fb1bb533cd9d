"""Run every registered query against its DuckDB statement: python check.py [sf_dir] [name ...]."""
from __future__ import annotations

import math
import sys
import time

import duckdb

from lamella.plans import REGISTRY
from lamella.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return ("f", round(v, 7) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for n in names:
        q = REGISTRY[n]
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if q.oracle is None:
                print(f"rows  {n}: {len(got[1])} rows {t1 - t0:.1f}s", flush=True)
                if not got[1]:
                    bad.append(n)
                continue
            res = con.execute(q.oracle)
            want = rows_of([d[0] for d in res.description], res.fetchall())
            t2 = time.time()
            if got == want:
                print(f"ok    {n}: {len(got[1])} rows {t1 - t0:.1f}s duck {t2 - t1:.1f}s" + ("   EMPTY" if not got[1] else ""), flush=True)
            else:
                bad.append(n)
                diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
                print(f"DIFF  {n}: {len(got[1])} vs {len(want[1])}; cols {got[0]} vs {want[0]}\n  " + "\n  ".join(f"{a}\n  {b}" for a, b in diff), flush=True)
        except Exception as e:
            bad.append(n)
            print(f"ERROR {n}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print(len(names) - len(bad), "of", len(names), "fine;", "bad:", bad)


if __name__ == "__main__":
    main()
