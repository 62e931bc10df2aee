import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens.functions.scalars import calendar_days, elapsed_days
from cartlens.operators import churn, clean, features, kpi, rfm

P = "customer_unique_id"


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


ORDER_SCHEMA = (
    "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
    "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
    "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
)


def orders(spark, rows):
    """(order, customer, status, bought, arrived, promised)"""
    full = [(o, c, s, ts(b), None, None, ts(a), ts(e)) for o, c, s, b, a, e in rows]
    return spark.createDataFrame(full, ORDER_SCHEMA)


def test_days_of_both_dialects(spark):
    df = spark.createDataFrame(
        [(ts("2020-01-03 01:00:00"), ts("2020-01-01 23:00:00")), (ts("2020-01-01 23:00:00"), ts("2020-01-03 01:00:00")),
         (ts("2020-01-01 00:00:00"), ts("2020-01-01 00:00:01")), (None, ts("2020-01-01"))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    got = df.select(calendar_days(F.col("a"), F.col("b")), elapsed_days(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2, 1), (-2, -2), (0, -1), (None, None)]


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("o1", "c1", "delivered", "2020-01-01 10:00:00", "2020-01-05 09:00:00", "2020-01-04"),
        ("o2", "c2", "delivered", "2020-02-01 10:00:00", None, "2020-02-09"),
        ("o3", "c3", "delivered", "2020-03-05 10:00:00", "2020-03-01 00:00:00", "2020-03-09"),
        ("o4", "c4", "shipped", "2020-03-05 10:00:00", "2020-03-06 00:00:00", "2020-03-09"),
        ("o5", "c9", "delivered", "2020-03-05 10:00:00", "2020-03-06 00:00:00", "2020-03-09"),
        ("o6", "c6", "delivered", None, "2020-03-06 00:00:00", "2020-03-09"),
        ("o7", "c7", None, "2020-03-05 10:00:00", "2020-03-06 00:00:00", "2020-03-09"),
    ]
    people = [("c1", "u1"), ("c2", "u1"), ("c3", "u2"), ("c4", "u2"), ("c6", "u3"), ("c7", "u3"), ("c8", None)]
    return orders(spark, rows), spark.createDataFrame(people, "customer_id string, customer_unique_id string")


def test_orders_clean(small):
    sql = {r.order_id: (r.delivery_days, r.delivery_delay_days) for r in clean.orders_clean(*small).collect()}
    assert sql == {"o1": (4, 1)}
    frame = {r.order_id: (r.delivery_days, r.delivery_delay_days) for r in clean.orders_clean(*small, "frame").collect()}
    assert frame == {"o1": (3, 1), "o2": (None, None), "o3": (-5, -8)}


def test_bad_dialect(small):
    with pytest.raises(ValueError):
        clean.orders_clean(*small, "other")


def test_funnel(small):
    rows = [(r.step, r.orders) for r in clean.clean_funnel(*small).orderBy("step").collect()]
    assert rows == [(1, 7), (2, 5), (3, 4), (4, 3)]


def test_parse_times(spark):
    df = spark.createDataFrame([("2020-01-01 05:06:07",), ("never",), (None,)], "order_approved_at string")
    got = [r[0] for r in clean.parse_times(df).collect()]
    assert got == [ts("2020-01-01 05:06:07"), None, None]


def test_latest_per_order(spark):
    df = spark.createDataFrame(
        [("a", ts("2020-01-01"), 1), ("a", ts("2020-01-03"), 2), ("b", ts("2020-01-02"), 3)],
        "order_id string, order_purchase_timestamp timestamp_ntz, x int",
    )
    assert sorted((r.order_id, r.x) for r in clean.latest_per_order(df).collect()) == [("a", 2), ("b", 3)]


def random_shop(spark, seed, n=300, hot=False):
    rng = np.random.default_rng(seed)
    users = rng.integers(0, 60, n)
    if hot:
        users[: n // 3] = 7
    day = rng.integers(0, 200, n)
    hour = rng.integers(0, 24, n)
    bought = [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d), hours=int(h)) for d, h in zip(day, hour)]
    pdf = pd.DataFrame({"order_id": range(n), P: users, "order_purchase_timestamp": bought})
    pdf["delivery_days"] = pd.array(np.where(rng.random(n) < 0.1, -1, rng.integers(0, 30, n)), "Int64")
    pdf["delivery_days"] = pdf["delivery_days"].where(rng.random(n) > 0.1)
    pdf["delivery_delay_days"] = pdf["delivery_days"] - 12
    schema = f"order_id bigint, {P} bigint, order_purchase_timestamp timestamp_ntz, delivery_days bigint, delivery_delay_days bigint"
    rows = [tuple(None if pd.isna(x) else (x.to_pydatetime() if hasattr(x, "to_pydatetime") else int(x)) for x in r)
            for r in pdf.itertuples(index=False)]
    m = int(n * 2)
    items = pd.DataFrame({
        "order_id": rng.integers(0, n + 20, m), "product_id": rng.integers(0, 30, m),
        "price": rng.integers(1, 5000, m) / 100, "freight_value": rng.integers(0, 500, m) / 100,
    })
    if hot:
        items.loc[: m // 3, "order_id"] = 5
    pays = pd.DataFrame({
        "order_id": rng.integers(0, n, n), "payment_sequential": range(n),
        "payment_type": rng.choice(["card", "cash", "voucher"], n), "payment_installments": rng.integers(1, 9, n),
        "payment_value": rng.integers(1, 9999, n) / 100,
    })
    revs = pd.DataFrame({
        "review_id": range(n), "order_id": rng.integers(0, n, n), "review_score": rng.integers(1, 6, n).astype(float),
        "review_comment_message": rng.choice(["good", "", "  ", None], n),
    })
    revs.loc[rng.random(n) < 0.1, "review_score"] = np.nan
    prods = pd.DataFrame({"product_id": range(30), "product_category_name": [None if i % 7 == 0 else f"k{i % 5}" for i in range(30)]})
    money = lambda df: df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in df.columns if c in ("price", "freight_value", "payment_value")})
    to = lambda p: money(spark.createDataFrame(p.astype(object).where(p.notna(), None).values.tolist(), ", ".join(
        f"{c} {'double' if c in ('price', 'freight_value', 'payment_value') else 'string' if p[c].dtype == object else 'int' if c == 'review_score' else 'bigint'}" for c in p.columns)
    )) if "review_score" not in p.columns else spark.createDataFrame(
        [(int(a), int(b), None if pd.isna(s) else int(s), t) for a, b, s, t in p.itertuples(index=False)],
        "review_id bigint, order_id bigint, review_score int, review_comment_message string")
    return pdf, items, pays, revs, prods, spark.createDataFrame(rows, schema), to(items), to(pays), to(revs), to(prods)


@pytest.mark.parametrize("hot", [False, True])
def test_fanout_features_equal_the_literal_join(spark, hot):
    pdf, items, pays, revs, prods, d_orders, d_items, d_pays, d_revs, d_prods = random_shop(spark, 5, hot=hot)
    wide = pdf.merge(items.merge(prods, on="product_id", how="left"), on="order_id", how="left").merge(
        pays, on="order_id", how="left").merge(revs, on="order_id", how="left")
    g = wide.groupby(P)
    lines = features._wide_orders(d_orders, d_items, d_pays, d_revs)
    got = features.feat_transaction_fanout(lines).toPandas().set_index(P).sort_index().astype(float)
    assert np.allclose(got["total_spend"], g["price"].sum() + g["freight_value"].sum())
    assert np.allclose(got["avg_items_per_order"], g["product_id"].count() / g["order_id"].nunique())
    rev = features.feat_review_fanout(lines).toPandas().set_index(P).sort_index()
    assert np.allclose(rev["avg_review_score"].astype(float), g["review_score"].mean(), equal_nan=True)
    assert rev["low_score_count"].tolist() == (wide["review_score"] <= 2).groupby(wide[P]).sum().tolist()
    assert rev["has_review_comment"].tolist() == wide["review_comment_message"].notna().groupby(wide[P]).any().tolist()
    mode = lambda x: x.mode().iloc[0] if len(x.mode()) else None
    pay = features.feat_payment_fanout(lines, d_pays).toPandas().set_index(P).sort_index()
    assert pay["main_payment_type"].tolist() == g["payment_type"].agg(mode).tolist()
    assert np.allclose(pay["avg_installments"].astype(float), g["payment_installments"].mean(), equal_nan=True)
    cat = features.feat_category_fanout(lines, d_items, d_prods).toPandas().set_index(P).sort_index()
    assert cat["main_category"].tolist() == g["product_category_name"].agg(mode).tolist()
    assert cat["category_diversity"].tolist() == g["product_category_name"].nunique().tolist()


def test_wide_table_equals_the_single_sets(spark):
    *_, d_orders, d_items, d_pays, d_revs, d_prods = random_shop(spark, 9)
    wide = features.user_features(d_orders, d_items, d_pays, d_revs, d_prods, "2020-09-01").toPandas().set_index(P).sort_index()
    parts = [
        features.feat_transaction(d_orders, d_items), features.feat_time(d_orders, "2020-09-01"),
        features.feat_delivery(d_orders), features.feat_category(d_orders, d_items, d_prods),
        features.feat_payment(d_orders, d_pays), features.feat_review(d_orders, d_revs),
    ]
    for part in parts:
        one = part.toPandas().set_index(P).reindex(wide.index)
        for c in one.columns:
            a, b = wide[c].astype(object).where(wide[c].notna(), None), one[c].astype(object).where(one[c].notna(), None)
            assert a.tolist() == b.tolist(), c


def test_person_without_items_payments_reviews(spark):
    cleaned = spark.createDataFrame(
        [(1, 1, ts("2020-01-01"), 3, 0)],
        f"order_id bigint, {P} bigint, order_purchase_timestamp timestamp_ntz, delivery_days int, delivery_delay_days int",
    )
    *_, items, pays, revs, prods = random_shop(spark, 1)
    none = lambda df: df.filter(F.lit(False))
    row = features.user_features(cleaned, none(items), none(pays), none(revs), prods, "2020-02-01").first()
    assert row.total_orders == 1 and row.total_spend == 0 and row.main_category is None
    assert row.main_payment_type is None and row.avg_review_score is None and row.avg_purchase_interval is None
    assert row.purchase_frequency == round(30 / 31, 4)


@pytest.mark.parametrize("dialect", ["sql", "frame"])
@pytest.mark.parametrize("least", [2, 4])
@pytest.mark.parametrize("hot", [False, True])
def test_intervals_equal_row_by_row_gaps(spark, dialect, least, hot):
    pdf, *_ , d_orders, _a, _b, _c, _d = random_shop(spark, 3, n=400, hot=hot)
    rows = pdf.sort_values([P, "order_purchase_timestamp"])
    counts = rows.groupby(P)["order_id"].transform("count")
    rows = rows[counts >= least]
    when = rows["order_purchase_timestamp"].dt.normalize() if dialect == "sql" else rows["order_purchase_timestamp"]
    gaps = when.groupby(rows[P]).diff().dropna().dt.days
    want = sorted(int(x) for x in gaps if dialect == "frame" or x > 0)
    got = churn.purchase_intervals(d_orders, dialect, least).toPandas()["purchase_interval_days"]
    assert sorted(int(x) for x in got) == want
    counted = churn.interval_counts(d_orders, dialect, least)
    if dialect == "frame":
        assert churn.churn_threshold(counted).first().p75_interval == pytest.approx(np.quantile(want, 0.75))
    else:
        share = pd.Series(want).rank(method="min").sub(1) / (len(want) - 1)
        assert churn.churn_threshold_sql(counted).first().p75_interval == min(v for v, s in zip(want, share) if s >= 0.75)


def test_many_gaps_on_one_day(spark):
    same = [(i, 1, ts("2020-01-01 10:00:00"), 1, 1) for i in range(10000)]
    df = spark.createDataFrame(same, f"order_id bigint, {P} bigint, order_purchase_timestamp timestamp_ntz, a int, b int")
    got = churn.purchase_intervals(df, "frame")
    assert got.count() == 9999 and got.agg(F.max("purchase_interval_days")).first()[0] == 0
    assert churn.purchase_intervals(df, "sql").count() == 0


def test_writeback_twice(spark):
    people = spark.createDataFrame([(1, 10, 1), (2, 99, 3)], f"{P} int, recency_days int, total_orders int")
    limit = spark.createDataFrame([(50.0,)], "churn_threshold double")
    labels = churn.churn_labels(people, limit)
    once = churn.churn_writeback(people, labels)
    assert churn.churn_writeback(once, labels).columns == once.columns
    assert {r[P]: r.is_churned for r in once.collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 50])
def test_rfm_scores(spark, partitions, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({P: range(n), "recency_days": rng.integers(0, 5, n), "purchase_frequency": rng.integers(0, 3, n) / 2,
                        "total_spend": rng.integers(0, 4, n) * 1.0})
    seen = set()
    for width in (1, 4, 30):
        partitions(width)
        got = rfm.rfm_ntile(spark.createDataFrame(pdf)).toPandas().sort_values(P)
        seen.add(tuple(map(tuple, got.to_numpy().tolist())))
    assert len(seen) == 1
    order = pdf.sort_values(["recency_days", P], ascending=[False, True])[P].tolist()
    tiles = [t + 1 for t, part in enumerate(np.array_split(np.arange(n), 4)) for _ in part]
    assert got.set_index(P)["rfm_r_score"].loc[order].tolist() == tiles
    if n >= 4:
        q = rfm.rfm_qcut(spark.createDataFrame(pdf)).toPandas().sort_values(P)
        cut = pd.qcut(pdf["recency_days"].rank(method="first"), 4, labels=[4, 3, 2, 1]).astype(int)
        assert q["rfm_r_score"].tolist() == cut.tolist()


def test_segment_ladder(spark):
    rows = [(4, 3, 3), (3, 2, 1), (3, 1, 3), (2, 2, 4), (2, 1, 4), (3, 1, 1)]
    df = spark.createDataFrame(rows, "rfm_r_score int, rfm_f_score int, rfm_m_score int")
    got = [r[0] for r in df.select(rfm.segment_label()).collect()]
    assert got == ["高价值客户", "重点保持", "重点保持", "需唤醒", "流失风险", "流失风险"]


def test_one_month_has_no_growth(spark):
    o = orders(spark, [("1", "c", "delivered", "2020-01-01", "2020-01-02", "2020-01-03")])
    items = spark.createDataFrame([("1", "p", "s", 10.0, 1.0)], "order_id string, product_id string, seller_id string, price double, freight_value double")
    items = items.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("price", "freight_value")})
    prods = spark.createDataFrame([("p", None)], "product_id string, product_category_name string")
    pays = spark.createDataFrame([("1", 1)], "order_id string, payment_sequential int")
    lines = kpi.sales_lines(o, items, prods, pays, {"x": 0.5})
    row = kpi.kpi_monthly_margin(lines).first()
    assert row.gmv_growth is None and row.gross_profit == pytest.approx(3.0) and row.gmv == 10.0
    assert kpi.kpi_category(lines).count() == 0


@pytest.mark.parametrize("fanout", [False, True])
def test_sales_of_a_hot_order(spark, fanout):
    pdf, items, pays, revs, prods, *_dfs = random_shop(spark, 21, hot=True)
    d_items, d_pays, d_prods = _dfs[1], _dfs[2], _dfs[4]
    o = spark.createDataFrame(
        [(int(i), int(i), "delivered", t.to_pydatetime()) for i, t in zip(pdf["order_id"], pdf["order_purchase_timestamp"])],
        "order_id bigint, customer_id bigint, order_status string, order_purchase_timestamp timestamp_ntz",
    )
    wide = pdf.merge(items.merge(prods, on="product_id", how="left"), on="order_id", how="left")
    if fanout:
        wide = wide.merge(pays, on="order_id", how="left")
    want = wide.groupby(wide["order_purchase_timestamp"].dt.strftime("%Y-%m"))["price"].sum()
    lines = kpi.sales_lines(o, d_items, d_prods, d_pays, {"k1": 0.5}, fanout=fanout)
    got = kpi.kpi_monthly_margin(lines).toPandas().set_index("month").sort_index()
    assert np.allclose(got["gmv"], want.sort_index())


def test_payments_are_read_once_and_only_if_asked_for(spark, data_dir):
    from cartlens.plans.registry import wide_features
    from cartlens.sources.adapter import StarSource

    def scans(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sum("l_returnflag" in line and "Aggregate" in line for line in plan.splitlines())

    source = StarSource(spark, data_dir)
    every = scans(source.order_payments.select("order_id", "payment_type"))
    whole = scans(wide_features(source))
    assert 0 < whole <= every + 2  # the source's own aggregation, then per order and per person
    assert scans(wide_features(source, columns=("recency_days", "avg_review_score"))) == 0


def test_lines_and_payments_of_other_orders_leave_before_they_are_summed(spark, data_dir):
    from cartlens.plans import registry
    from cartlens.sources.adapter import StarSource

    s = StarSource(spark, data_dir)
    plan = registry.wide_features(s)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    for column in ("item_count", "installment_max"):
        summed = min(i for i, line in enumerate(plan) if "Aggregate [order_id#" in line and f"AS {column}#" in line)
        below = [line for i, line in enumerate(plan) if i > summed and all(deep(x) > deep(plan[summed]) for x in plan[summed + 1:i + 1])]
        assert any("Join LeftSemi" in line for line in below)
