import math
import random

import duckdb
import pytest

from cartlens.llm import op1_topk as t
from cartlens.llm.registry import ORACLES


def brute(rows, k=20):
    vectors = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        vectors[i] = min(vectors.get(i, w), w)
    out = []
    for q, v in vectors.items():
        if q % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def vectors(n=400, size=6, big=1.0):
    rnd = random.Random(n)
    rows = [(i, [rnd.gauss(0, 0.4) * big for _ in range(size)]) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(n // 3)]
    rows += [(2 * n + 1, None), (2 * n + 2, [1.0, None]), (2 * n + 20, [float("nan")] * size), (2 * n + 40, [float("inf")] * size), (None, same)]
    rows += [(2 * n + 60, []), (2 * n + 61, [0.5]), rows[3], (5, [0.25] * size)]
    return rows


@pytest.mark.parametrize("big", [1.0, 3e4, 1e7])
def test_against_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(t, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(t, "QUERY_BLOCK", 7)
    monkeypatch.setattr(t, "LIST_DEPTH", 1)
    rows = vectors(big=big)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, t.top_k(df).collect())) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, t.top_k(df).collect())) == brute(rows)
    assert t.top_k(df.filter("false")).count() == 0
    assert t.top_k(df.filter("vec_id = 0")).count() == 0


def test_same_as_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{data_dir}/embeddings.parquet')")
    assert sorted(map(tuple, t.op1_topk(spark, data_dir).collect())) == sorted(con.execute(ORACLES["op1_topk"]).fetchall())


def test_blocks_meet_in_bounded_groups(spark, monkeypatch):
    for name, size in (("VECTOR_BLOCK", 60), ("QUERY_BLOCK", 2), ("PARTY", 3)):
        monkeypatch.setattr(t, name, size, raising=False)
    rows = vectors(300)
    plans = []
    real = t.written

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return real(df, name)

    monkeypatch.setattr(t, "written", kept)
    got = t.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)
    # a batch of rows that hold a pair of blocks each has no bound in bytes
    assert not any("MapInArrow" in p.replace("FlatMapCoGroupsInArrow", "") for p in plans)
