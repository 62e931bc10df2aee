"""Every registered query: a Spark callable and, where one exists, the DuckDB text it is checked against.

Each query reads the driver's whole tables through ``StarSource``. Results leave in plain types, so
both engines can be compared: decimals as doubles, whole numbers as bigint, flags as 0 and 1.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.config import FRAME, SQL
from cartlens.plans import oracle as o
from cartlens.sources.adapter import CUTOFF, StarSource
from cartlens.operators import churn, clean, features, rfm
from cartlens.operators.features import PERSON
from cartlens.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, category: str = "p_type"):
    """Registers ``fn(source)`` under ``name``; ``sql`` is the text it must agree with."""

    def add(fn: Callable[[StarSource], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(StarSource(spark, folder, category)))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def on(tables: str, body: str) -> str:
    return f"WITH RECURSIVE {tables}\n{body}"


MODEL, FEATURES, FRAMES, REVIEWS = o.model_tables(), o.feature_tables(), o.frame_tables(), o.review_tables()
BRAND = "p_brand"


# --- shared inputs ---------------------------------------------------------------------------

def cleaned(s: StarSource, dialect: str = SQL) -> DataFrame:
    return clean.orders_clean(s.delivered, s.customer_keys, dialect)


def wide_features(s: StarSource, dialect: str = SQL, columns: Sequence[str] = features.FEATURE_ORDER) -> DataFrame:
    """The orders are written once, as several sets read them."""
    return features.user_features(
        written(cleaned(s, dialect), "cleaned"), s.order_items, s.order_payments, s.order_reviews, s.products, CUTOFF,
        dialect, columns=columns,
    )


def scored_features(s: StarSource) -> DataFrame:
    """The feature columns that ranks and labels need, without the text and category joins, written once."""
    rows = cleaned(s)
    base = features.feat_transaction(rows, s.order_items).join(features.feat_time(rows, CUTOFF), PERSON)
    return written(base, "features")


def frame_core(s: StarSource) -> DataFrame:
    rows = cleaned(s, FRAME)
    return written(
        features.feat_transaction_fanout(fan(s)).join(features.feat_time(rows, CUTOFF, FRAME), PERSON), "features"
    )


def fan(s: StarSource, texts: bool = False) -> DataFrame:
    reviewed = s.order_reviews if texts else s.review_scores
    return features._wide_orders(cleaned(s, FRAME), s.order_items, s.order_payments, reviewed)


def gap_counts(s: StarSource, dialect: str = SQL) -> DataFrame:
    return churn.interval_counts(cleaned(s, dialect), dialect)


def labels(s: StarSource, base: DataFrame | None = None) -> DataFrame:
    if base is None:
        base = spine(s)
    return churn.churn_labels(base, churn.churn_threshold_sql(gap_counts(s)))


def spine(s: StarSource) -> DataFrame:
    """Person, order count, recency: all that labels need, straight from the orders."""
    end = F.lit(CUTOFF).cast("timestamp_ntz")
    return cleaned(s).groupBy(PERSON).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.datediff(end, F.max("order_purchase_timestamp")).alias("recency_days"),
    )


def labelled(s: StarSource) -> DataFrame:
    base = scored_features(s)
    with_scores = rfm.with_rfm(base)
    return with_scores.join(labels(s, base).select(PERSON, "is_churned"), PERSON)


# --- cleaning --------------------------------------------------------------------------------

query("clean_filter", on(MODEL, "SELECT order_id, customer_id, order_status FROM m_orders WHERE order_status = 'delivered'"))(
    lambda s: clean.keep_delivered(s.delivered).select("order_id", "customer_id", "order_status")
)


@query("clean_parse_ts", """SELECT o_orderkey AS order_id,
  try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)
    AS order_purchase_timestamp FROM orders""")
def _(s):
    text = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    raw = s.raw("orders").select(F.col("o_orderkey").alias("order_id"), text.alias("order_purchase_timestamp"))
    return clean.parse_times(raw)


@query("clean_dropna", """SELECT o_orderkey AS order_id, o_orderkey AS customer_id, o_orderdate AS order_purchase_timestamp
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderdate IS NOT NULL""")
def _(s):
    k = F.col("o_orderkey")
    return clean.drop_incomplete(
        s.raw("orders").select(
            k.alias("order_id"), F.when(k % 7 != 0, k).alias("customer_id"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        )
    )


query("clean_join_customer", on(MODEL, "SELECT order_id, customer_id, customer_unique_id FROM m_orders"))(
    lambda s: clean.add_person(s.orders, s.customer_keys).select("order_id", "customer_id", "customer_unique_id")
)

for _name, _dialect, _day in (("clean_delivery", SQL, o.calendar), ("clean_delivery_frame", FRAME, o.elapsed)):
    query(_name, on(MODEL, f"""SELECT order_id, {_day('delivered_ts', 'purchase_ts')} AS delivery_days,
      {_day('delivered_ts', 'estimated_ts')} AS delivery_delay_days FROM m_orders"""))(
        lambda s, d=_dialect: clean.add_delivery_days(s.orders, d).select(
            "order_id", "delivery_days", "delivery_delay_days"
        )
    )

query("orders_clean", on(MODEL, f"SELECT {o._CLEAN_COLUMNS} FROM m_clean"))(cleaned)
query("orders_clean_frame", on(MODEL, f"SELECT {o._CLEAN_COLUMNS} FROM m_frame"))(lambda s: cleaned(s, FRAME))


@query("dedupe_latest", """SELECT l_orderkey AS order_id, max(l_shipdate) AS order_purchase_timestamp FROM lineitem GROUP BY 1""")
def _(s):
    return clean.latest_per_order(
        s.order_items.select("order_id", F.col("shipping_limit_date").alias("order_purchase_timestamp"))
    )


query("clean_quality", on(MODEL, f"""SELECT count(*) AS total_orders, count(DISTINCT customer_unique_id) AS unique_users,
  min(purchase_ts) AS earliest_order, max(purchase_ts) AS latest_order,
  {o.rnd('sum(delivery_days)', 'count(*)', 1)} AS avg_delivery_days,
  {o.rnd('sum(delivery_delay_days)', 'count(*)', 1)} AS avg_delay_days,
  {o.rnd('100 * sum(CASE WHEN delivery_delay_days > 0 THEN 1 ELSE 0 END)', 'count(*)', 2)} AS delayed_pct FROM m_clean"""))(
    lambda s: clean.clean_quality(cleaned(s))
)

query("clean_funnel", on(MODEL, """, c AS (SELECT count(*) AS a, count(CASE WHEN order_status = 'delivered' THEN 1 END) AS b FROM m_orders),
  m AS (SELECT median(delivery_days) AS d FROM m_frame)
  SELECT step, stage, orders, CAST(orders AS DOUBLE) / a AS retained_ratio,
    CASE WHEN step = 4 THEN d END AS median_delivery_days
  FROM (SELECT a, d, unnest([1, 2, 3, 4]) AS step, unnest(['原始数据', '仅delivered', '去除缺失', '最终数据']) AS stage,
    unnest([a, b, b, b]) AS orders FROM c CROSS JOIN m)""".lstrip()))(
    lambda s: clean.clean_funnel(s.orders, s.customer_keys)
)


# --- customer features -----------------------------------------------------------------------

query("feat_transaction", on(FEATURES, "SELECT * FROM f_transaction"))(
    lambda s: features.feat_transaction(cleaned(s), s.order_items)
)
query("feat_transaction_fanout", on(FRAMES, "SELECT * FROM g_transaction"))(
    lambda s: features.feat_transaction_fanout(fan(s))
)
query("feat_time", on(FEATURES, "SELECT * FROM f_time"))(lambda s: features.feat_time(cleaned(s), CUTOFF))
query("feat_time_frame", on(FRAMES, "SELECT * FROM g_time"))(
    lambda s: features.feat_time(cleaned(s, FRAME), CUTOFF, FRAME)
)
query("feat_delivery", on(FEATURES, "SELECT * FROM f_delivery"))(lambda s: features.feat_delivery(cleaned(s)))
query("feat_delivery_frame", on(FRAMES, "SELECT * FROM g_delivery"))(
    lambda s: features.feat_delivery(cleaned(s, FRAME), FRAME)
)
query("feat_category", on(o.feature_tables(BRAND), "SELECT * FROM f_category"), BRAND)(
    lambda s: features.feat_category(cleaned(s), s.order_items, s.products)
)
query("feat_category_mode", on(o.frame_tables(BRAND), "SELECT customer_unique_id, main_category FROM g_category"), BRAND)(
    lambda s: features.feat_category_mode(fan(s), s.order_items, s.products)
)
query("feat_category_fanout", on(FRAMES, "SELECT * FROM g_category"))(
    lambda s: features.feat_category_fanout(fan(s), s.order_items, s.products)
)
query("feat_payment", on(FEATURES, "SELECT * FROM f_payment"))(
    lambda s: features.feat_payment(cleaned(s), s.order_payments)
)
query("feat_payment_fanout", on(FRAMES, "SELECT * FROM g_payment"))(
    lambda s: features.feat_payment_fanout(fan(s), s.order_payments)
)
query("feat_review", on(FEATURES, "SELECT * FROM f_review"))(
    lambda s: features.feat_review(cleaned(s), s.order_reviews)
)
query("feat_review_fanout", on(FRAMES, "SELECT * FROM g_review"))(
    lambda s: features.feat_review_fanout(fan(s, texts=True))
)
query("user_features", on(FEATURES, "SELECT * FROM features"))(wide_features)
query("user_features_frame", on(FRAMES, "SELECT * FROM g_features"))(lambda s: wide_features(s, FRAME))

query("rfm_ntile", on(FEATURES, "SELECT * FROM scores"))(lambda s: rfm.rfm_ntile(scored_features(s)))
query("rfm_qcut", on(FRAMES, "SELECT * FROM q_scores"))(lambda s: rfm.rfm_qcut(frame_core(s)))
query("rfm_segment", on(FEATURES, "SELECT * FROM segments"))(
    lambda s: rfm.rfm_segment(rfm.rfm_ntile(scored_features(s)))
)
query("rfm_distribution", on(FEATURES, f"""SELECT rfm_segment, count(*) AS user_count,
  {o.rnd('100 * count(*)', '(SELECT count(*) FROM segments)', 2)} AS pct FROM segments GROUP BY 1"""))(
    lambda s: rfm.rfm_distribution(rfm.rfm_segment(rfm.rfm_ntile(scored_features(s))))
)

query("rfm_manual", on(FEATURES, """, e AS (SELECT quantile_cont(recency_days, 0.25) AS a, quantile_cont(recency_days, 0.5) AS b,
    quantile_cont(recency_days, 0.75) AS c FROM features),
  k AS (SELECT customer_unique_id, recency_days, count(*) OVER () AS n,
    row_number() OVER (ORDER BY total_orders, customer_unique_id) AS f,
    row_number() OVER (ORDER BY total_spend, customer_unique_id) AS m FROM features),
  p AS (SELECT customer_unique_id, CASE WHEN recency_days <= a THEN 4 WHEN recency_days <= b THEN 3
      WHEN recency_days <= c THEN 2 ELSE 1 END AS r_score,
    greatest(1, (4 * (f - 1) + n - 2) // (n - 1)) AS f_score, greatest(1, (4 * (m - 1) + n - 2) // (n - 1)) AS m_score
    FROM k CROSS JOIN e)
  SELECT *, r_score + f_score + m_score AS rfm_total, CASE WHEN r_score + f_score + m_score >= 10 THEN '重要价值客户'
    WHEN r_score + f_score + m_score >= 8 THEN '重要发展客户' WHEN r_score + f_score + m_score >= 6 THEN '一般价值客户'
    ELSE '流失客户' END AS rfm_segment FROM p""".lstrip()))(lambda s: rfm.rfm_manual(scored_features(s)))

_LABELLED = "features JOIN segments USING (customer_unique_id) JOIN labels_ USING (customer_unique_id)"
query("segment_profile", on(FEATURES, """SELECT rfm_segment,
  CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_spend,
  CAST(sum(f.total_orders) AS DOUBLE) / count(*) AS avg_orders, CAST(sum(f.recency_days) AS DOUBLE) / count(*) AS avg_recency,
  CAST(sum(is_churned) AS DOUBLE) / count(*) AS churn_rate, count(*) AS user_count,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM features) AS user_share
  FROM features f JOIN segments USING (customer_unique_id) JOIN labels_ USING (customer_unique_id) GROUP BY 1"""))(
    lambda s: rfm.segment_profile(labelled(s))
)

query("segment_box", on(FEATURES, """, v AS (SELECT rfm_segment, unnest(['total_spend', 'total_orders', 'recency_days']) AS measure,
    unnest([total_spend, CAST(total_orders AS DOUBLE), CAST(recency_days AS DOUBLE)]) AS x
    FROM features JOIN segments USING (customer_unique_id))
  SELECT measure, rfm_segment, min(x) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median,
    round(quantile_cont(x, 0.75), 4) AS q3, max(x) AS max,
    CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM v GROUP BY 1, 2""".lstrip()))(
    lambda s: rfm.segment_box(rfm.with_rfm(scored_features(s))).withColumns(
        {q: F.round(q, 4) for q in ("q1", "median", "q3")}
    )
)


def _hist_sql(value: str, source: str, bins: int = 50) -> str:
    return f"""{value}_lim AS (SELECT min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi FROM {source}),
  {value}_cnt AS (SELECT least(CAST(floor((CAST({value} AS DOUBLE) - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
    FROM {source} CROSS JOIN {value}_lim WHERE {value} IS NOT NULL GROUP BY 1),
  {value}_bins AS (SELECT r.bin, lo + r.bin * ((hi - lo) / {bins}) AS lower_edge, lo + (r.bin + 1) * ((hi - lo) / {bins}) AS upper_edge,
    coalesce(n, 0) AS n FROM (SELECT unnest(range({bins})) AS bin) r CROSS JOIN {value}_lim LEFT JOIN {value}_cnt b ON r.bin = b.bin)"""


_MEASURES = ("recency_days", "total_orders", "total_spend")


@query("rfm_histogram", on(FEATURES + ",\n", ",\n".join(_hist_sql(m, "features") for m in _MEASURES) + " UNION ALL ".join(
    f"""
  SELECT '{m}' AS measure, bin, round(lower_edge, 6) AS lower_edge, round(upper_edge, 6) AS upper_edge, n,
    round((SELECT quantile_cont({m}, 0.5) FROM features), 4) AS median FROM {m}_bins""" for m in _MEASURES)))
def _(s):
    base = scored_features(s)
    parts = [rfm.rfm_histogram(base, m) for m in _MEASURES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns(
        {"lower_edge": F.round("lower_edge", 6), "upper_edge": F.round("upper_edge", 6), "median": F.round("median", 4)}
    )


query("features_summary", on(FEATURES, f"""SELECT count(*) AS total_users, count(rfm_segment) AS rfm_labeled,
  {o.rnd('sum(total_orders)', 'count(*)', 2)} AS avg_orders,
  {o.rnd(o.cents('sum(CAST(total_spend AS DECIMAL(18,2)))'), 'count(*) * 100', 2)} AS avg_spend,
  {o.rnd('sum(recency_days)', 'count(*)', 1)} AS avg_recency FROM features JOIN segments USING (customer_unique_id)"""))(
    lambda s: features.features_summary(rfm.with_rfm(scored_features(s)))
)


@query("missing_profile", on(FEATURES, "SELECT column_name, null_count, round(null_count / CAST(n AS DOUBLE), 6) AS null_ratio FROM ("
  + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS n FROM features"
    for c in ("customer_unique_id", *features.FEATURE_ORDER)) + ")"))
def _(s):
    return features.missing_profile(wide_features(s))


# --- churn -----------------------------------------------------------------------------------

query("purchase_intervals", on(FEATURES, "SELECT customer_unique_id, purchase_interval_days FROM intervals"))(
    lambda s: churn.purchase_intervals(cleaned(s))
)
query("purchase_intervals_frame", on(FRAMES, "SELECT customer_unique_id, purchase_interval_days FROM g_intervals"))(
    lambda s: churn.purchase_intervals(cleaned(s, FRAME), FRAME)
)
query("churn_threshold", on(FRAMES, "SELECT * FROM g_threshold"))(
    lambda s: churn.churn_threshold(gap_counts(s, FRAME))
)
query("churn_threshold_sql", on(FEATURES, "SELECT * FROM threshold"))(
    lambda s: churn.churn_threshold_sql(gap_counts(s))
)
query("churn_labels", on(FEATURES, "SELECT * FROM labels_"))(labels)


@query("churn_labels_frame", on(FRAMES, "SELECT * FROM g_labels"))
def _(s):
    base = features.feat_time(cleaned(s, FRAME), CUTOFF, FRAME).join(
        cleaned(s, FRAME).groupBy(PERSON).agg(F.count(F.lit(1)).alias("total_orders")), PERSON
    )
    return churn.churn_labels(base, churn.churn_threshold(gap_counts(s, FRAME)))


query("churn_writeback", on(FEATURES, "SELECT f.*, is_churned FROM features f JOIN labels_ USING (customer_unique_id)"))(
    lambda s: churn.churn_writeback(wide_features(s), labels(s))
)
query("churn_summary", on(FEATURES, f"""SELECT max(churn_threshold) AS churn_threshold_days, count(*) AS total_users,
  CAST(sum(is_churned) AS BIGINT) AS churned_users, {o.rnd('100 * sum(is_churned)', 'count(*)', 2)} AS churn_rate_pct FROM labels_"""))(
    lambda s: churn.churn_summary(labels(s))
)
query("churn_by_order_group", on(FEATURES, f"""SELECT CASE WHEN total_orders = 1 THEN '单次购买'
  WHEN total_orders BETWEEN 2 AND 3 THEN '2-3次' ELSE '4次以上' END AS order_group, count(*) AS user_count,
  CAST(sum(is_churned) AS BIGINT) AS churned, {o.rnd('100 * sum(is_churned)', 'count(*)', 2)} AS churn_rate_pct
  FROM labels_ GROUP BY 1"""))(lambda s: churn.churn_by_order_group(labels(s)))
query("churn_single_vs_multi", on(FEATURES, """SELECT count(CASE WHEN total_orders = 1 THEN 1 END) AS single_users,
  CAST(count(CASE WHEN total_orders = 1 AND is_churned = 1 THEN 1 END) AS DOUBLE) / count(CASE WHEN total_orders = 1 THEN 1 END) AS single_churn_rate,
  count(CASE WHEN total_orders >= 2 THEN 1 END) AS multi_users,
  CAST(count(CASE WHEN total_orders >= 2 AND is_churned = 1 THEN 1 END) AS DOUBLE) / count(CASE WHEN total_orders >= 2 THEN 1 END) AS multi_churn_rate,
  (SELECT CAST(sum(purchase_interval_days) AS DOUBLE) / count(*) FROM intervals) AS interval_mean,
  (SELECT quantile_cont(purchase_interval_days, 0.5) FROM intervals) AS interval_median,
  (SELECT quantile_cont(purchase_interval_days, 0.75) FROM intervals) AS interval_p75 FROM labels_"""))(
    lambda s: churn.churn_single_vs_multi(labels(s), gap_counts(s))
)
