import base64
import hashlib
import os
import random

import duckdb
import pytest

from cartlens.llm import op5_warc as w
from cartlens.llm.registry import ORACLES


def pages():
    rnd = random.Random(8)
    out = [(i, f"http://h{i % 7}/é p?{i}\n", f"<html>{'x' * rnd.randrange(0, 400)}é{i}</html>", "r") for i in range(120)]
    out += [(200 + i, None, "<p>same</p>", None) for i in range(50)]
    out += [(300, "u", None, "a"), (301, "u", "", "a"), (302, "v", "long " * 400_000, "b"), (None, "n", "only null id", "c"), (None, "n", "<p>same</p>", "c")]
    return out + [out[3], out[169]]


def test_write_and_read_back(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(5)
    index = w.write_archives(df, str(tmp_path / "arc"))
    assert index.count() == len(rows)
    holder = {}
    for i, _, h, _ in rows:
        h = h or ""
        holder[h] = max([x for x in (holder.get(h), i) if x is not None], default=None)
    want = []
    for i, u, h, _ in rows:
        h = h or ""
        to = None if i == holder[h] else holder[h]
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if to is None else "revisit", to, u, h if to is None else None))
    got = [tuple(r) for r in w.read_records(index, payloads=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    some = index.filter("page_id % 7 = 3")
    assert {r.page_id for r in w.read_records(some).collect()} == {i for i, *_ in rows if i is not None and i % 7 == 3}
    # archives are plain gzip members one after another
    import gzip

    raw = b"".join(gzip.open(tmp_path / "arc" / f).read() for f in os.listdir(tmp_path / "arc"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows)


def test_ranges_join_neighbours():
    files, offsets = ["a"] * 4 + ["b"], [0, 10, 10 + w.GAP_BYTES + 100, w.READ_BYTES + 10_000_000, 0]
    assert list(w.ranges(files, offsets, [10] * 5)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.read_records(w.write_archives(df)).count() == 0


def test_same_as_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{data_dir}/pages.parquet')")
    cur = con.execute(ORACLES["op5_warc"])
    names = [d[0] for d in cur.description]
    got = w.op5_warc(spark, data_dir)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))
