"""Runs registered queries beside their checking texts: `python tools/check.py [sf] [key-prefix ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import octroi.catalog  # noqa: E402, F401
from octroi.catalog import registry  # noqa: E402
from octroi.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, key, folder):
    t = time.time()
    df = registry.spark_queries()[key](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    text = registry.checking_texts().get(key)
    if text is None:
        return "rows-only", len(got[1]), spent, None
    t = time.time()
    cur = con.execute(text)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    oracle = time.time() - t
    if got == want:
        return ("ok" if want[1] else "EMPTY"), len(got[1]), spent, f"{oracle:.1f}"
    detail = f"columns {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}"
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    detail += f"\n   spark only: {list(a - b)[:3]}\n   check only: {list(b - a)[:3]}"
    return "DIFF", len(got[1]), spent, detail


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = build_session("local[8]"), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    keys = [k for k in registry.QUERIES if not args or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in args)]
    bad = []
    for k in keys:
        try:
            state, n, spent, detail = compare(spark, con, k, folder)
        except Exception as e:  # noqa: BLE001
            state, n, spent, detail = "ERROR", 0, 0.0, str(e)[:900]
        if state not in ("ok", "rows-only"):
            bad.append(k)
        print(f"{state:9} {k:28} rows={n:<8} {spent:6.2f}s {detail or ''}", flush=True)
    print(f"{len(keys)} run, not ok: {bad}")


if __name__ == "__main__":
    main()
