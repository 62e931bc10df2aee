import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens.operators import effect, matching
from cartlens.operators.features import PERSON as P


def serial(pdf, caliper, k):
    """One treated row after the other takes its nearest free control among its k nearest."""
    controls = pdf[pdf["treatment"] == 0]
    used, pairs = set(), set()
    for _, t in pdf[pdf["treatment"] == 1].sort_values(P).iterrows():
        gap = (controls["propensity_score"] - t["propensity_score"]).abs()
        near = pd.DataFrame({"gap": gap, "id": controls[P]}).sort_values(["gap", "id"]).head(k)
        for _, c in near.iterrows():
            if c["gap"] <= caliper and int(c["id"]) not in used:
                used.add(int(c["id"]))
                pairs.add((int(t[P]), int(c["id"])))
                break
    return pairs


def random_study(seed, n, treated, levels):
    rng = np.random.default_rng(seed)
    score = rng.random(n) if levels is None else rng.integers(0, levels, n) / levels
    return pd.DataFrame({P: rng.permutation(n * 3)[:n], "treatment": (rng.random(n) < treated).astype(int), "propensity_score": score})


def pairs_of(df):
    return {(r.t_id, r.c_id) for r in df.collect()}


@pytest.mark.parametrize("seed,n,treated,levels,caliper,k", [
    (1, 200, 0.3, None, 0.05, 10),
    (2, 200, 0.7, None, 0.05, 10),
    (3, 200, 0.5, 8, 0.05, 10),      # many equal scores
    (4, 200, 0.5, 1, 0.05, 10),      # one score for all
    (5, 60, 0.5, None, 0.5, 3),
    (6, 30, 0.9, None, 1.0, 10),     # fewer controls than candidates
    (7, 150, 0.6, 40, 0.2, 4),
])
def test_equals_taking_turns(spark, seed, n, treated, levels, caliper, k):
    pdf = random_study(seed, n, treated, levels)
    df = spark.createDataFrame(pdf).repartition(5)
    assert pairs_of(matching.match_pairs(df, P, caliper=caliper, k=k)) == serial(pdf, caliper, k)


@pytest.mark.parametrize("block_rows", [1, 2, 7, 64])
def test_block_size_changes_nothing(spark, block_rows):
    pdf = random_study(11, 160, 0.6, None)
    df = spark.createDataFrame(pdf)
    wishes = matching.match_candidates(df, P, "treatment", "propensity_score", 0.1, 6)
    assert pairs_of(matching.resolve(wishes, block_rows)) == serial(pdf, 0.1, 6)


def test_pair_rules(spark):
    pdf = random_study(12, 300, 0.4, None)
    got = matching.match_pairs(spark.createDataFrame(pdf), P, caliper=0.03).toPandas()
    assert got["t_id"].is_unique and got["c_id"].is_unique and (got["gap"] <= 0.03).all()


def test_no_controls(spark):
    pdf = random_study(13, 20, 1.1, None)
    assert matching.match_pairs(spark.createDataFrame(pdf), P).count() == 0


def test_widening(spark):
    pdf = pd.DataFrame({P: [1, 2, 3, 4], "treatment": [1, 1, 0, 0], "propensity_score": [0.10, 0.50, 0.18, 0.58]})
    df = spark.createDataFrame(pdf)
    pairs, used, rate = matching.match_widened(df, P)
    assert (used, rate) == (0.1, 1.0) and pairs_of(pairs) == {(1, 3), (2, 4)}
    pairs, used, rate = matching.match_widened(df, P, caliper=0.09)
    assert (used, rate) == (0.09, 1.0)


def cells(spark, n11, n10, n01, n00):
    return spark.createDataFrame([(n11, n10, n01, n00)], "n11 bigint, n10 bigint, n01 bigint, n00 bigint")


def test_bounds_without_discordant_pairs(spark):
    rows = effect.psm_rosenbaum(cells(spark, 5, 0, 0, 5)).collect()
    assert [r.p_upper_bound for r in rows] == [0.5] * 4


def test_interval_holds_the_effect(spark):
    c = cells(spark, 400, 120, 60, 420)
    draws = effect.psm_bootstrap(c, 300)
    ci = effect.bootstrap_interval(draws).first()
    att = effect.psm_att(c).first().att
    assert ci.ci_lower < att < ci.ci_upper and ci.replicates == 300
    assert ci.ci_upper - ci.ci_lower == pytest.approx(4 * np.sqrt((0.18 - att**2) / 1000), rel=0.25)
    assert effect.psm_bootstrap(c, 20).collect() == effect.psm_bootstrap(c.repartition(3), 20).collect()


def test_balance_without_spread(spark):
    df = spark.createDataFrame([(1, 1, 3.0, "treatment"), (2, 0, 3.0, "control"), (3, 1, 3.0, "treatment"), (4, 0, 3.0, "control")],
                               f"{P} int, treatment int, x double, match_group string")
    row = effect.psm_balance(df, df, ["x"]).first()
    assert (row.smd_before, row.smd_after, row.balanced) == (0.0, 0.0, True)


def test_score_is_the_logistic_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    t = (rng.random(400) < 1 / (1 + np.exp(-x))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({P: range(400), "treatment": t, "x": x}))
    ps = effect.psm_score(df, ["x"]).toPandas().sort_values(P)["propensity_score"].to_numpy()
    w = np.polyfit(x, np.log(ps / (1 - ps)), 1)
    # gradient of sum(loss) + w^2/2 vanishes; the intercept is not penalised
    assert abs(np.sum((ps - t) * x) + w[0]) < 1e-2 and abs(np.sum(ps - t)) < 1e-2


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_all_treated_in_one_gap(spark, partitions, order):
    partitions(7)
    rng = np.random.default_rng(3)
    t = np.sort(0.4 + 0.01 * rng.random(1500))
    t = {"up": t, "down": t[::-1], "mixed": rng.permutation(t)}[order]
    c = np.concatenate([0.39 * rng.random(40), 0.42 + 0.3 * rng.random(40)])
    pdf = pd.DataFrame({P: range(1580), "treatment": [1] * 1500 + [0] * 80, "propensity_score": np.concatenate([t, c])})
    got = matching.match_pairs(spark.createDataFrame(pdf).repartition(4), P, caliper=0.5, k=5)
    assert pairs_of(got) == serial(pdf, 0.5, 5)


def test_only_refused_rows_ask_again(spark, monkeypatch):
    sizes = []
    real = matching.written
    monkeypatch.setattr(matching, "written", lambda df, name="t": (lambda w: sizes.append((name, w.count())) or w)(real(df, name)))
    pdf = random_study(4, 3000, 0.4, None)
    got = matching.match_pairs(spark.createDataFrame(pdf), P, caliper=0.05)
    assert pairs_of(got) == serial(pdf, 0.05, 10)
    told = [n for name, n in sizes if name == "match-told"]
    assert sum(told) < 0.1 * dict(sizes)["match-wishes"]
