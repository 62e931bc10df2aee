import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens.operators.ordered import (
    equal_width_bins, exact_quantiles, global_rank, running_totals,
)
from cartlens.operators import selection


def frame(spark, n, values, parts=7):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"id": rng.permutation(n), "v": rng.integers(0, values, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("width", [1, 4, 40])
@pytest.mark.parametrize("values", [1, 3, 1000])
def test_global_rank_is_a_row_number(spark, partitions, width, values):
    partitions(width)
    pdf, df = frame(spark, 333, values)
    got = global_rank(df, [F.desc("v"), "id"]).toPandas().sort_values("rank")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["rank"].tolist() == list(range(1, 334)) and set(got["group_size"]) == {333}


def test_global_rank_within_groups(spark, partitions):
    partitions(16)
    pdf, df = frame(spark, 500, 50)
    pdf["g"] = np.where(pdf["id"] % 3 == 0, "a", "b")
    df = df.withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    got = global_rank(df, ["v", "id"], within=["g"]).toPandas().set_index("id").sort_index()
    pdf = pdf.sort_values(["v", "id"])
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    pdf["n"] = pdf.groupby("g")["id"].transform("count")
    want = pdf.set_index("id").sort_index()
    assert got["rank"].tolist() == want["rank"].tolist()
    assert got["group_size"].tolist() == want["n"].tolist()


def test_running_totals(spark, partitions):
    partitions(9)
    pdf, df = frame(spark, 400, 20)
    got = running_totals(df.withColumn("one", F.lit(2)), ["v", "id"], {"upto": "v", "ones": "one"}).toPandas()
    got = got.sort_values(["v", "id"])
    assert got["upto"].tolist() == got["v"].cumsum().tolist()
    assert got["ones"].tolist() == list(range(2, 802, 2))


@pytest.mark.parametrize("n", list(range(1, 14)) + [33, 50])
def test_ends_of_bins(n):
    tiles = [len(part) for part in np.array_split(np.arange(n), 4)]
    assert selection.ntile_ends(n, 4) == np.cumsum(tiles)[:-1].tolist()
    if n >= 4:
        cut = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=False)
        assert selection.quantile_ends(n, 4) == [int((cut <= i).sum()) for i in range(3)]


@pytest.mark.parametrize("key", ["bigint", "string"])
@pytest.mark.parametrize("values", [1, 2, 100000])
def test_selected_rows_are_those_of_the_sorted_frame(spark, monkeypatch, key, values):
    """Small leaves and few pivots force several passes; one value may hold all rows, keys may repeat."""
    monkeypatch.setattr(selection, "LEAF", 20)
    monkeypatch.setattr(selection, "PIVOTS", 5)
    rng = np.random.default_rng(values)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "v": rng.integers(0, values, 3000) * 0.5,
                        "k": rng.integers(0, 2000, 3000)})
    pdf.loc[:700, ["v", "k"]] = [0.5, 7]  # one key held by a quarter of the rows
    df = spark.createDataFrame(pdf).withColumn("k", F.col("k").cast(key)).repartition(5).cache()
    rows = {g: sorted((r.v, r.k) for r in part) for g, part in
            ((g, [r for r in df.collect() if r.g == g]) for g in "ab")}
    sizes = selection.group_sizes(df, ["g"])
    assert sizes == {(g,): len(x) for g, x in rows.items()}
    wanted = {g: {1, n // 3, n // 2, n} for g, n in sizes.items()}
    got = selection.rows_at(df, [F.col("v"), F.col("k")], wanted, sizes, ["g"])
    assert got == {(g, r): rows[g[0]][r - 1] for g, places in wanted.items() for r in places}
    df.unpersist()


def test_selection_puts_nan_last_and_takes_missing_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("x", 2.0), ("x", None)], "g string, v double")
    got = {r["g"]: r["top"] for r in exact_quantiles(df, "v", {"top": 1.0}, within=["g"]).collect()}
    assert np.isnan(got[None]) and got["x"] == 2.0
    assert exact_quantiles(df.filter("false"), "v", {"top": 1.0}, within=["g"]).count() == 0


@pytest.mark.parametrize("drawn", ["all", "some", "none"])
def test_buckets_are_sought_not_compared_one_by_one(spark, drawn):
    """The plan must not grow with the pivots: written out as a tree it was too large for generated code."""
    inf, nan = float("inf"), float("nan")
    values = [-inf, -2.5, -0.0, 1.0, 4.0, inf, nan]
    keys = [(v, k) for v in values for k in ("a", "b")]
    pivots = {"all": [keys[1::3], keys[::2]], "some": [keys[3:4], []], "none": [[], []]}[drawn]
    df = spark.createDataFrame([(g, *k) for g in (0, 1) for k in keys], "g int, v double, k string")
    opened = [selection._Open((g,), None, None, 0, len(keys)) for g in (0, 1)]
    got = selection._numbered(df, opened, ["g"], [F.col("v"), F.col("k")], pivots)
    order = [repr(k) for k in keys]
    place = {repr(k): order.index(repr(k)) for k in keys}
    for r in got.collect():
        at = [place[repr(p)] for p in pivots[r["_at"]]]
        mine = place[repr((r["_k0"], r["_k1"]))]
        assert r["_bucket"] == 2 * sum(p < mine for p in at) + (mine in at)
    many = [[(float(i), str(i)) for i in range(63)]] * 2
    ends = [selection._Open((g,), (float(i), "a"), (i + 0.5, "b"), 0, 1) for g in (0, 1) for i in range(6)]
    plan = selection._numbered(df, ends, ["g"], [F.col("v"), F.col("k")], many * 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 5 and plan.count(" AND ") < 20


def test_exact_quantiles(spark, partitions):
    partitions(6)
    pdf, df = frame(spark, 257, 40)
    df = df.withColumn("g", F.col("id") % 2)
    got = exact_quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.6, "d": 1.0}, within=["g"]).toPandas()
    for _, row in got.iterrows():
        want = np.quantile(pdf[pdf["id"] % 2 == row["g"]]["v"], [0, 0.25, 0.6, 1])
        assert np.allclose([row["a"], row["b"], row["c"], row["d"]], want)


def test_equal_width_bins(spark):
    pdf, df = frame(spark, 300, 1000)
    got = equal_width_bins(df, "v", 50).toPandas().sort_values("bin")
    counts, edges = np.histogram(pdf["v"], bins=50)
    assert got["n"].sum() == 300 and len(got) == 50
    assert np.allclose(got["lower_edge"], edges[:-1])
    assert np.abs(got["n"].to_numpy() - counts).sum() <= 4  # values on an edge may fall on either side
    same = equal_width_bins(df.withColumn("v", F.lit(3.0)), "v", 5).toPandas()
    assert same["n"].sum() == 300


def test_no_window_over_all_rows(spark):
    """Only the few per-partition rows may meet in one task, never the ranked rows."""
    _, df = frame(spark, 100, 10)
    plan = global_rank(df, ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Window") < plan.rindex("HashAggregate") < plan.rindex("FileScan")
    assert "Window" not in plan[plan.rindex("HashAggregate"):]


def test_describe_takes_quartiles_from_counts(spark):
    from cartlens.operators.explore import eda_describe

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 5, 101).astype(float), "b": rng.normal(size=101), "c": ["x"] * 101, "d": [7.0] * 101})
    pdf.loc[::4, "b"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c string, d double").withColumn("e", F.lit(None).cast("int"))
    got = eda_describe(df).toPandas().set_index("column_name")
    want = pdf[["a", "b", "d"]].describe()
    for c in want:
        assert got.loc[c, ["std", "p25", "p50", "p75"]].astype(float).tolist() == pytest.approx(want[c][["std", "25%", "50%", "75%"]].tolist(), abs=2e-6)
    assert len(got) == 5 and got.loc[["c", "e"], ["mean", "std", "p50"]].isna().all().all()
