import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from cartlens.llm import op11_vafile as v
from cartlens.llm.registry import ORACLES, QUERIES


def brute(rows, size, k=8, rounds=10):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(1024 * c) for c in x]))
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in hashed[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        centroids = [
            [sum(c) // len(c) for c in zip(*[x for (_, x), o in zip(kept, own) if o == j])] if j in own else centroids[j]
            for j in range(len(centroids))
        ]
    return [(i, *nearest(x)[::-1]) for i, x in kept], centroids


def vectors(n, size, seed=1):
    rnd = random.Random(seed)
    mids = [[rnd.gauss(0, 0.2) for _ in range(size)] for _ in range(5)]
    rows = [(i, [rnd.gauss(m, 0.1) for m in mids[i % 5]]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]  # a third of all are copies
    odd = [None, [], [0.5] * (size - 1), [0.5] * (size + 1), [None] + [0.1] * (size - 1), [float("nan")] * size, [float("inf")] + [0.0] * (size - 1)]
    rows += [(10_000 + i, x) for i, x in enumerate(odd)]
    return rows + [(None, [0.25] * size), rows[0], rows[0], (7, [0.75] * size), (20_000, [0.0] * size)]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, id int")


@pytest.mark.parametrize("size, bits, block", [(6, 8, 4096), (6, 3, 17), (2, 1, 50), (64, 6, 64)])
def test_against_brute_force(spark, monkeypatch, size, bits, block):
    monkeypatch.setattr(v, "BLOCK", block)
    rows = vectors(150, size)
    found, centroids = v.clusters(frame(spark, rows).repartition(3), size=size, bits=bits)
    want, last = brute(rows, size)
    assert centroids.tolist() == last
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in found.collect()) == Counter(want)


def test_cells_spare_most_vectors():
    rnd = np.random.default_rng(4)
    x = np.floor(1024 * rnd.normal(0, 0.12, (3000, 64))).astype(np.int64)
    edges = np.concatenate([np.quantile(x, np.linspace(0, 1, 257)[:-1], axis=0).astype(np.int64), x.max(axis=0)[None] + 1]).T
    first, sure = v.Bounds(x[:8], edges).nearest(v.cells_of(x, edges))
    assert (v.distances(x[sure], x[:8]).argmin(axis=1) == first[sure]).all()
    assert sure.mean() > 0.7


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)]
    found, _ = v.clusters(frame(spark, rows), size=2, rounds=0)
    want, _ = brute(rows, 2, rounds=0)
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in found.collect()) == Counter(want)


def test_odd_tables(spark):
    for rows in ([], [(1, None)], [(None, [0.5] * 3)]):
        found, centroids = v.clusters(frame(spark, rows), size=3)
        assert found.count() == 0 and len(centroids) == 0
    few = [(1, [0.5, 1.0, 2.0]), (2, [0.0, -1.0, -2.5]), (2, [0.0, -1.0, -2.5])]
    found, centroids = v.clusters(frame(spark, few), size=3)
    want, last = brute(few, 3)
    assert centroids.tolist() == last and Counter((r["id"], r["cluster"], r["distance"]) for r in found.collect()) == Counter(want)
    with pytest.raises(OverflowError):
        v.clusters(frame(spark, [(1, [1e9, 0.0, 0.0])]), size=3)


def test_query_against_its_text(spark, data_dir, tmp_path):
    rows = vectors(300, 64, seed=9)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for folder, files in ((data_dir, "embeddings.parquet"), (str(tmp_path), "embeddings.parquet/*.parquet")):
        got = QUERIES["op11_vafile"](spark, folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/{files}')")
        want = con.execute(ORACLES["op11_vafile"])
        names = [d[0] for d in want.description]
        assert got.columns == names
        assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())
