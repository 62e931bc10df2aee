"""Runs registered queries beside their DuckDB texts and reports differences: [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from cartlens.plans import catalog
from cartlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(got, want) -> str:
    gc, gr = got
    wc, wr = want
    if gc != wc:
        return f"columns differ: only spark {set(gc) - set(wc)}, only duckdb {set(wc) - set(gc)}"
    if len(gr) != len(wr):
        return f"rows differ: spark {len(gr)}, duckdb {len(wr)}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b or any(type(x) is not type(y) for x, y in zip(a, b))]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(gc, a, b) if x != y or type(x) is not type(y)]
        return f"{len(bad)} of {len(gr)} rows differ, first: {diff}"
    return ""


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    names = argv[1:] or list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in oracles:
                print(f"rows {name:28s} {took:6.2f}s {len(got[1])} rows", flush=True)
                continue
            start = time.time()
            cur = con.execute(oracles[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            message = compare(got, want)
            ok = "ok  " if not message else "FAIL"
            failed += bool(message)
            print(f"{ok} {name:28s} {took:6.2f}s duckdb {time.time() - start:5.2f}s {len(got[1])} rows {message}", flush=True)
        except Exception as error:
            failed += 1
            print(f"FAIL {name:28s} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
