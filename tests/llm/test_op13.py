import math
import random

import numpy as np
import pytest

from cartlens.llm import op13_whitening as w
from cartlens.llm.registry import QUERIES


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "c", 1.0) for i, x in rows], "vec_id long, embedding array<double>, component string, _key double")


def kept(rows):
    out = [(i, x) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    size = max(len(x) for _, x in out)
    return [(i, [math.floor(1024 * c) + 100_000 for c in x] + [100_000] * (size - len(x))) for i, x in out]


def vectors(n, size, seed=3):
    rnd = random.Random(seed)
    spread = [0.02 * (1 + j % 9) for j in range(size)]
    rows = [(i, [rnd.gauss(0.3, s) for s in spread]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(n // 2)]
    rows += [(5000 + i, x) for i, x in enumerate([None, [None] * size, [float("nan")] + [0.0] * (size - 1), [float("-inf")] * size])]
    return rows + [(None, [0.1] * size), rows[0], (0, [0.5] * size), (9000, [0.25]), (9001, [])]


@pytest.mark.parametrize("n, size", [(200, 12), (300, 64), (40, 3)])
def test_against_eigh(spark, n, size):
    rows = vectors(n, size)
    ints = kept(rows)
    x = np.array([v for _, v in ints], float)
    cov = np.cov(x.T, bias=True)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    models = [w.fit(frame(spark, rows).repartition(p)) for p in (1, 5)]
    assert (models[0].values == models[1].values).all() and (models[0].components == models[1].components).all()
    model = models[0]
    assert model.moments.n == len(ints) and np.allclose(model.moments.covariance, cov, rtol=1e-9, atol=1e-6)
    assert np.allclose(model.values, values, rtol=1e-9)
    assert np.allclose(np.abs((model.components * vecs).sum(axis=0)), 1, atol=1e-9)
    assert np.allclose(model.explained, values / np.trace(cov))
    got = w.whitened(frame(spark, rows), model)
    n_all, sums = len(ints), [sum(c) for c in zip(*[v for _, v in ints])]
    want = sorted((-1 if i is None else i, sum((n_all * c - s) ** 2 for c, s in zip(v, sums))) for i, v in ints)
    done = got.collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["deviation"]) for r in done) == want
    z = np.array([r["whitened"] for r in done])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(z.shape[1])).max() < 1e-9
    assert w.identity_error(got, z.shape[1]) < 1e-9


def symmetric(size, values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (q * values) @ q.T


def test_counts_are_those_of_the_spectrum():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 3, 10, 40):
        m = rnd.normal(size=(size, size))
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in [*rnd.normal(size=20) * 3, *((values[1:] + values[:-1]) / 2)]:
            assert w.above(m, shift) == (values > shift).sum()
    assert w.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert w.above(np.zeros((4, 4)), 0.0) == 0


@pytest.mark.parametrize("values", [
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5],
    [5, 5, 5, 3, 3, 1, 1, 1, 1, 1],
    [1 + 1e-7, 1, 1 - 1e-7, 1 - 1e-13, 0.5, 1e-9, 0, 0, 0, 0],
    [1e6, 1, 1e-3, 0, 0, 0, 0, 0, 0, 0],
    [2] * 10,
])
def test_close_equal_and_vanishing_eigenvalues(values):
    m = symmetric(10, np.array(values, float))
    got, vecs = w.leading(m, 8)
    assert np.allclose(got, sorted(values)[::-1][: len(got)], atol=1e-12 * max(values))
    assert len(got) == min(8, sum(v > 1e-11 * max(values) for v in values))
    assert np.abs(vecs.T @ vecs - np.eye(len(got))).max() < 1e-12
    assert np.abs(m @ vecs - vecs * got).max() < 1e-12 * max(values)


def test_rayleigh_steps_are_few(monkeypatch):
    steps = []
    real = w.Slicer.step
    monkeypatch.setattr(w.Slicer, "step", lambda self, shift, x: steps.append(shift) or real(self, shift, x))
    w.leading(symmetric(30, np.linspace(1, 30, 30)), 8)
    assert len(steps) <= 8 * 10  # wrong starts included


def test_exact_sums_of_large_entries(spark):
    rows = [(1, [3e12, 0.0]), (2, [-3e12, 1.0]), (3, [1e12, 2.0])]
    model = w.fit(frame(spark, rows))
    assert model.moments.sums == [sum(c) for c in zip(*[v for _, v in kept(rows)])]
    assert len(model.values) == 1  # the second direction is lost in rounding
    got = {r["id"]: r["deviation"] for r in w.whitened(frame(spark, rows), model).collect()}
    assert got == {1: None, 2: None, 3: None}
    with pytest.raises(Exception, match="too large"):
        w.fit(frame(spark, [(1, [1e18])]))


def test_odd_tables(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.5]) for i in range(5)])):
        model = w.fit(frame(spark, rows))
        assert model is None or len(model.values) == 0
        folder = str(tmp_path / str(k))
        frame(spark, rows).select("vec_id", "embedding").write.parquet(f"{folder}/embeddings.parquet")
        assert QUERIES["op13_whitening"](spark, folder).collect() == []


def test_query(spark, data_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    ints = kept(rows)
    got = QUERIES["op13_whitening"](spark, data_dir).collect()
    assert len(got) == 8 * len(ints) and {r["n"] for r in got} == {len(ints)}
    assert {r["component"] for r in got} == set(range(1, 9))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    x = np.array([v for _, v in ints], float)
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    place = {i: k for k, (i, _) in enumerate(ints)}
    z = np.zeros((len(ints), 8))
    for r in got:
        z[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - values[-r["component"]] / values.sum()) < 1e-9
    want = (x - x.mean(axis=0)) @ vecs[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-6
