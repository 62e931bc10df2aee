import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens.operators import churn_model as m
from cartlens.operators import cluster as cl
from cartlens.operators.features import PERSON as P
from cartlens.operators.neighbours import nearest_neighbours

NAMES = ["a", "b", "c"]


def points(seed, n, kind):
    rng = np.random.default_rng(seed)
    x = {"round": rng.normal(size=(n, 3)), "long": rng.normal(size=(n, 3)) * [1000, 1, 1],
         "grid": rng.integers(0, 3, (n, 3)).astype(float), "copies": np.where(rng.random((n, 1)) < 0.4, 1.0, rng.normal(size=(n, 3)))}[kind]
    return pd.DataFrame({P: range(n), **{c: x[:, i] for i, c in enumerate(NAMES)}})


@pytest.mark.parametrize("kind", ["round", "long", "grid", "copies"])
@pytest.mark.parametrize("block_rows", [8, 64, 2048])
def test_neighbours_are_exact(spark, kind, block_rows):
    pdf = points(3, 150, kind)
    got = nearest_neighbours(spark.createDataFrame(pdf), P, NAMES, 5, block_rows).toPandas().set_index("id")
    x = pdf[NAMES].to_numpy()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    assert len(got) == 150
    for i in range(150):
        near = got.loc[i, "near"]
        assert i not in [v["id"] for v in near] and len({v["id"] for v in near}) == 5
        assert np.allclose([v["dist"] for v in near], np.sort(far[i])[:5])


def labelled(seed=1, n=300, share=0.2):
    pdf = points(seed, n, "long")
    rng = np.random.default_rng(seed)
    pdf[m.TARGET] = (rng.random(n) < share).astype(float)
    pdf["a"] += pdf[m.TARGET] * 1500
    return pdf


def test_split_and_folds_are_exact_and_fixed(spark):
    pdf = labelled()
    df = spark.createDataFrame(pdf)
    one, two = m.ml_split(df).toPandas(), m.ml_split(df.repartition(9)).toPandas()
    assert one.sort_values(P)["split"].tolist() == two.sort_values(P)["split"].tolist()
    for label, part in one.groupby(m.TARGET):
        assert (part["split"] == "test").sum() == round(len(part) * 0.2)
    folds = m.ml_folds(df).toPandas().groupby([m.TARGET, "fold"]).size().unstack()
    assert (folds.max(axis=1) - folds.min(axis=1)).max() <= 1


def test_new_rows_lie_between_their_parents(spark):
    pdf = labelled()
    df = spark.createDataFrame(pdf)
    out = m.ml_smote(df, NAMES, block_rows=16).toPandas()
    sizes = out.groupby(m.TARGET).size()
    assert sizes[0.0] == sizes[1.0]
    kept = out[out["synthetic"] == 0].sort_values(P)
    assert np.allclose(kept[NAMES].to_numpy(), pdf[NAMES].to_numpy())
    made, by = out[out["synthetic"] == 1], pdf.set_index(P)
    assert set(made[m.TARGET]) == {1.0}
    a, b = by.loc[made["parent_a"], NAMES].to_numpy(), by.loc[made["parent_b"], NAMES].to_numpy()
    y = made[NAMES].to_numpy()
    u = ((y - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1)
    assert ((u >= -1e-9) & (u < 1)).all() and np.allclose(a + u[:, None] * (b - a), y)
    small = by[by[m.TARGET] == 1]
    for pa, pb in zip(made["parent_a"], made["parent_b"]):
        d = np.sqrt(((small[NAMES] - small.loc[pa, NAMES]) ** 2).sum(axis=1)).drop(pa)
        assert d[pb] <= np.sort(d)[4] + 1e-9


def test_learners_and_metrics(spark):
    pdf = labelled()
    df = m.ml_split(spark.createDataFrame(pdf))
    train, test = df.filter("split = 'train'").cache(), df.filter("split = 'test'").cache()
    for learner in m.learners(5):
        fit = m.fit_learner(learner, train, NAMES)
        got = m.predict(fit, test).cache()
        scores = m.evaluate(got)
        area = m.roc_auc(m.ml_roc(got)).first()[0]
        assert scores["roc_auc"] == pytest.approx(area, abs=1e-9) and 0.5 < area <= 1
        assert m.ml_confusion(got).agg(F.sum("n")).first()[0] == test.count()
        weights = m.ml_importance(fit, NAMES, train).toPandas()
        assert len(weights) == 3 and (weights["importance"] >= 0).all()


def test_cross_validation_shape(spark):
    df = spark.createDataFrame(labelled(n=120))
    models = m.learners(2)[:1]
    cv = m.ml_cv(df, NAMES, models, folds=3)
    assert cv.count() == 3
    flat = m.ml_cv(df, NAMES, models, folds=3, smote_inside=False)
    assert flat.count() == 3
    best = m.ml_select_best(m.ml_comparison(cv, {models[0].name: {x: 0.5 for x in m.METRICS}})).first()
    assert best.model == models[0].name and best.test_auc_roc == 0.5


def test_feature_rule():
    from pyspark.sql import types as T

    class Frame:
        dtypes = [("customer_unique_id", "bigint"), ("first_purchase_date", "timestamp_ntz"), ("recency_days", "int"),
                  ("customer_tenure_days", "int"), ("purchase_frequency", "double"), ("rfm_f_score", "int"),
                  ("rfm_segment", "string"), ("main_category", "string"), ("is_churned", "int"), ("when", "timestamp")]

    assert m.ml_feature_select(Frame) == ["recency_days", "customer_tenure_days", "purchase_frequency", "rfm_f_score", "main_category"]
    assert m.ml_feature_select(Frame, "no_leak") == ["main_category"]


def test_clusters(spark):
    rng = np.random.default_rng(2)
    centre = np.repeat([[0, 0], [50, 0], [0, 50]], 40, axis=0)
    pdf = pd.DataFrame(centre + rng.normal(size=(120, 2)), columns=["x", "y"])
    pdf[P] = range(120)
    pdf.loc[3, "x"] = np.nan
    df = cl.impute_median(spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "x double, y double, customer_unique_id bigint"), ["x", "y"])
    assert df.filter(f"{P} = 3").first().x == pytest.approx(pdf["x"].median())
    scaled = cl.standardize(df, ["x", "y"]).toPandas()
    assert np.allclose(scaled[["x", "y"]].std(ddof=0), 1) and np.allclose(scaled[["x", "y"]].mean(), 0)
    v = cl.as_vectors(cl.standardize(df, ["x", "y"]), ["x", "y"]).cache()
    models = cl.kmeans_scan(v, [2, 3, 4], restarts=2)
    inertia = cl.kmeans_elbow(v, models).toPandas().sort_values("k")["inertia"].tolist()
    assert inertia[0] > inertia[1] > inertia[2]
    best = cl.kmeans_silhouette(v, models).filter("is_best").first()
    assert best.k == 3
    sizes = cl.kmeans_assign(v, models[3]).groupBy("cluster").count().toPandas()["count"]
    assert sorted(sizes) == [39, 40, 41] or sorted(sizes) == [40, 40, 40]
    pts, shares = cl.pca2(v)
    parts = {r.component: r.explained_ratio for r in shares.collect()}
    assert sum(parts.values()) == pytest.approx(1) and parts["pc1"] >= parts["pc2"]


def test_askers_restrict_who_asks(spark):
    df = spark.createDataFrame(points(4, 200, "round"))
    every = {r["id"]: r["near"] for r in nearest_neighbours(df, P, NAMES, 4, 16).collect()}
    some = {r["id"]: r["near"] for r in nearest_neighbours(df, P, NAMES, 4, 16, df.filter(f"{P} % 7 = 0").select(F.col(P).alias("id"))).collect()}
    assert some == {i: near for i, near in every.items() if i % 7 == 0}


def test_few_points_have_few_neighbours(spark):
    df = spark.createDataFrame(points(4, 3, "round"))
    assert {len(r["near"]) for r in nearest_neighbours(df, P, NAMES, 5).collect()} == {2}
    assert nearest_neighbours(df.limit(0), P, NAMES, 5).count() == 0


def test_visited_cells_stay_bounded_as_round_data_grows(spark, monkeypatch):
    from cartlens.operators import neighbours as nb

    visits = []
    real = nb.asked
    monkeypatch.setattr(nb, "asked", lambda asks, *rest: visits.append(asks.count()) or real(asks, *rest))
    per_point = []
    for n in (1000, 8000):
        visits.clear()
        nearest_neighbours(spark.createDataFrame(points(6, n, "round")), P, NAMES, 5, 64)
        per_point.append(sum(visits) / n)
    assert per_point[1] < 1.5 * per_point[0] and per_point[1] < 0.2 * 8000 / 64
    visits.clear()
    nearest_neighbours(spark.createDataFrame(points(6, 2000, "copies")), P, NAMES, 5, 64)
    assert sum(visits) < 20 * 2000


def plain_best(x, ids, i, k):
    far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    return sorted((far[j], ids[j]) for j in range(len(x)) if ids[j] != ids[i])[:k]


@pytest.mark.parametrize("kind", ["round", "long", "grid"])
@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_few_points_of_a_cell_get_plain_differences(monkeypatch, kind, offset):
    from cartlens.operators import neighbours as nb

    pdf = points(11, 1500, kind)
    x, ids = pdf[NAMES].to_numpy() + offset, pdf[P].to_numpy()[::-1].copy()
    monkeypatch.setattr(nb, "_best_plainly", None)  # the product alone must rule out most
    got = list(nb._best(x, ids, x, ids, 5))
    for i in range(0, 1500, 50):
        want = plain_best(x, ids, i, 5)
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want], rtol=1e-12, atol=0)
        if kind == "grid":  # of equally near ones the smaller keys
            assert [j for _, j in got[i]] == [j for _, j in want]


@pytest.mark.parametrize("odd", [1.0, np.nan, np.inf, 1e200])
def test_copies_and_overflow_take_the_plain_way(odd):
    from cartlens.operators import neighbours as nb

    x, ids = np.ones((40, 3)), np.array([f"k{i:02d}" for i in range(40)], dtype=object)
    x[:3] = odd
    with np.errstate(all="ignore"):
        got = list(nb._best(x[3:], ids[3:], x, ids, 4))
    assert all(len(g) == 4 and {d for d, _ in g} == {0.0} for g in got)
    assert all(ids[3 + i] not in [j for _, j in g] for i, g in enumerate(got))
    assert [list(nb._best(x[:1], ids[:1], x[:1], ids[:1], 4))] == [[[]]]


def test_metrics_of_all_groups_in_one_pass(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"model": rng.choice(["x", "y"], 600), "fold": rng.integers(0, 3, 600), m.TARGET: (rng.random(600) < 0.3).astype(float)})
    pdf["score"] = np.round(0.3 * pdf[m.TARGET] + 0.7 * rng.random(600), 1)
    pdf["prediction"] = (pdf["score"] >= 0.5).astype(float)
    got = m.all_metrics(spark.createDataFrame(pdf).repartition(5), ["model", "fold"]).toPandas().set_index(["model", "fold"])
    assert len(got) == 6
    for at, part in pdf.groupby(["model", "fold"]):
        y, s, g = part[m.TARGET] == 1, part["score"], part["prediction"] == 1
        tp, fp, fn = (y & g).sum(), (~y & g).sum(), (y & ~g).sum()
        pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y] for b in s[~y]]
        want = [(y == g).mean(), tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), np.mean(pairs)]
        assert np.allclose(got.loc[at, list(m.METRICS)].to_numpy(float), want)


def test_one_search_serves_all_folds(spark, monkeypatch):
    pdf = labelled(seed=8, n=150)
    dealt = m.ml_folds(spark.createDataFrame(pdf), 3).cache()
    calls = []
    real = m.nearest_neighbours
    monkeypatch.setattr(m, "nearest_neighbours", lambda *a, **k: calls.append(1) or real(*a, **k))
    fold_of = {r[P]: r["fold"] for r in dealt.collect()}
    small = pdf[pdf[m.TARGET] == 1].set_index(P)[NAMES]
    for margin, most in ((30, 1), (0, 4)):
        calls.clear()
        got = m.fold_friends(dealt, NAMES, 3, margin=margin)
        assert len(calls) <= most and sorted(got) == [0, 1, 2]
        for fold, friends in got.items():
            kept = small[[fold_of[i] != fold for i in small.index]]
            rows = friends.collect()
            assert {r["id"] for r in rows} == set(kept.index)
            for r in rows:
                d = np.sqrt(((kept - kept.loc[r["id"]]) ** 2).sum(axis=1)).drop(r["id"])
                assert len(set(r["friends"])) == min(5, len(d))
                assert np.allclose(sorted(d[r["friends"]]), np.sort(d)[:5])


def test_saved_model_codes_raw_rows(spark, tmp_path):
    pdf = labelled(n=200)
    pdf["kind"] = np.where(pdf[P] % 5 == 0, None, np.where(pdf[P] % 2 == 0, "b", "a"))
    pdf.loc[::9, "b"] = np.nan
    raw = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), f"{P} bigint, a double, b double, c double, {m.TARGET} double, kind string")
    table, names = m.ml_table(raw)
    assert sorted(names) == ["a", "b", "c", "kind"]
    fit = m.fit_learner(m.learners()[0], table, names)
    m.ml_save_model(m.with_coders(fit, raw, names), str(tmp_path / "model"))
    loaded = m.ml_load_model(str(tmp_path / "model"))
    assert m.model_features(loaded) == names and m.model_labels(loaded) == {"kind": ["a", "b", "unknown"]}
    want = {r[P]: r["score"] for r in m.predict(fit, table).collect()}
    got = {r[P]: r["score"] for r in m.predict(loaded, raw.drop(m.TARGET)).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    other = loaded.transform(raw.withColumn("kind", F.lit("new"))).select("kind").distinct().collect()
    assert [r["kind"] for r in other] == [3.0]


def test_clusters_of_all_restarts_improve_together(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["x", "y"])
    v = cl.as_vectors(spark.createDataFrame(pdf), ["x", "y"]).coalesce(1).cache()
    passes = []
    real = cl.round_sums
    monkeypatch.setattr(cl, "round_sums", lambda points, sets: passes.append(len(sets)) or real(points, sets), raising=False)
    models = cl.kmeans_scan(v, [2, 3], restarts=2)
    alone = {k: [KMeans(k=k, seed=42 + i, maxIter=300, tol=1e-4).fit(v) for i in range(2)] for k in (2, 3)}
    assert passes[0] == 4 and len(passes) <= max(m.summary.numIter for fits in alone.values() for m in fits)
    for k, fits in alone.items():
        best = min(fits, key=lambda m: m.summary.trainingCost)
        assert models[k].cost == pytest.approx(best.summary.trainingCost)
        assert np.allclose(models[k].centers, np.array(best.clusterCenters()))
        mine = [r["prediction"] for r in models[k].transform(v).select("prediction").collect()]
        assert mine == [r["prediction"] for r in best.transform(v).select("prediction").collect()]


def test_fits_run_on_few_partitions(spark, monkeypatch):
    pdf = pd.DataFrame({"x": np.arange(60) % 7 * 1.0, "is_churned": (np.arange(60) % 2) * 1.0})
    rows = spark.createDataFrame(pdf).repartition(12)
    seen = []
    fit = m.Pipeline.fit
    monkeypatch.setattr(m.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    m.fit_learner(m.learners()[0], rows, ["x"])
    assert seen == [1]


def test_models_are_tested_beside_the_folds(spark, monkeypatch):
    import threading
    from types import SimpleNamespace

    from cartlens.plans import registry_models as rm

    df = m.ml_split(spark.createDataFrame(labelled(n=120)))
    monkeypatch.setattr(rm, "split_sides", lambda s: (df.filter("split = 'train'"), df.filter("split = 'test'"), NAMES))
    monkeypatch.setattr(m, "learners", lambda trees: [m.Learner("a", "logistic"), m.Learner("b", "logistic")])
    inside, tested, evaluate = threading.Event(), [], m.evaluate

    def folds(train, names, models):
        assert inside.wait(120)  # the last model has its test figures before the folds are done
        return spark.createDataFrame([(x.name, f, *[0.5 + f] * 5) for x in models for f in (0, 1)], "model string, fold int, " + ", ".join(f"{c} double" for c in m.METRICS))

    def noted(predicted):
        tested.append(evaluate(predicted))
        if len(tested) == 2:
            inside.set()
        return tested[-1]

    monkeypatch.setattr(m, "ml_cv", folds)
    monkeypatch.setattr(m, "evaluate", noted)
    rows = {r["model"]: r for r in rm.compared(SimpleNamespace(spark=spark)).collect()}
    assert sorted(rows) == ["a", "b"] and tested[0] == tested[1]
    assert all(r["test_auc_roc"] == tested[0]["roc_auc"] and r["cv_f1_mean"] == 1.0 for r in rows.values())
