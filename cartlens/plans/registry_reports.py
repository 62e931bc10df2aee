"""Registered queries: business reports, reviews, exploration, recoding, sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens import fixed_values as fv
from cartlens.config import Thresholds
from cartlens.operators import explore, keywords, kpi, recode, reviews
from cartlens.plans import oracle as o
from cartlens.plans.pipeline import Job
from cartlens.plans.registry import BRAND, FEATURES, MODEL, REVIEWS, cleaned, on, query, _hist_sql
from cartlens.session import scratch_path
from cartlens.sources import tables
from cartlens.sources.adapter import CUTOFF, MARGINS, PAYMENT_CODES

SALES, SALES_FAN = o.sales_tables(False), o.sales_tables(True)

# --- business reports ------------------------------------------------------------------------

query("kpi_monthly", on(MODEL, """SELECT strftime(purchase_ts, '%Y-%m') AS year_month, count(DISTINCT o.order_id) AS order_count,
  CAST(sum(price) AS DOUBLE) AS gmv, CAST(sum(freight_value) AS DOUBLE) AS total_freight,
  CAST(sum(price) AS DOUBLE) / count(DISTINCT o.order_id) AS aov
  FROM m_orders o JOIN m_items i ON o.order_id = i.order_id WHERE order_status = 'delivered' GROUP BY 1"""))(
    lambda s: kpi.kpi_monthly(s.delivered, s.order_items)
)
query("kpi_category_top20", on(o.model_tables(BRAND), """SELECT product_category_name, count(DISTINCT o.order_id) AS order_count,
  CAST(sum(price) AS DOUBLE) AS total_revenue, CAST(sum(price) AS DOUBLE) / count(price) AS avg_price,
  count(DISTINCT seller_id) AS seller_count
  FROM m_orders o JOIN m_items i ON o.order_id = i.order_id JOIN m_products p ON i.product_id = p.product_id
  WHERE order_status = 'delivered' GROUP BY 1 ORDER BY total_revenue DESC, product_category_name LIMIT 20"""), BRAND)(
    lambda s: kpi.kpi_category_top(s.delivered, s.order_items, s.products)
)
query("kpi_repeat_rate", on(MODEL, f"""SELECT count(*) AS total_users, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_users,
  {o.rnd('100 * sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)', 'count(*)', 2)} AS repeat_rate_pct
  FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM m_orders WHERE order_status = 'delivered' GROUP BY 1)"""))(
    lambda s: kpi.kpi_repeat_rate(s.delivered, s.customer_keys)
)
query("kpi_payment_share", on(MODEL, f"""SELECT payment_type, count(DISTINCT p.order_id) AS order_count,
  CAST(sum(payment_value) AS DOUBLE) AS total_payment_value,
  {o.rnd('100 * count(DISTINCT p.order_id)', '(SELECT count(DISTINCT order_id) FROM m_payments)', 2)} AS share_pct,
  CAST(sum(payment_installments) AS DOUBLE) / count(*) AS avg_installments
  FROM m_payments p JOIN m_orders o ON p.order_id = o.order_id WHERE order_status = 'delivered' GROUP BY 1"""))(
    lambda s: kpi.kpi_payment_share(s.order_payments, s.delivered)
)
query("kpi_monthly_repeat", on(MODEL, f"""SELECT year_month, count(*) AS active_users,
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_in_month,
  {o.rnd('100 * sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)', 'count(*)', 2)} AS monthly_repeat_rate_pct
  FROM (SELECT customer_unique_id, strftime(purchase_ts, '%Y-%m') AS year_month, count(DISTINCT order_id) AS n
    FROM m_orders WHERE order_status = 'delivered' GROUP BY 1, 2) GROUP BY 1"""))(
    lambda s: kpi.kpi_monthly_repeat(s.delivered, s.customer_keys)
)
query("kpi_base", on(MODEL, """SELECT o.order_id, o.customer_id, purchase_ts AS order_purchase_timestamp, order_status, i.product_id,
  seller_id, CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value, product_category_name,
  customer_state, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value,
  strftime(purchase_ts, '%Y-%m') AS year_month
  FROM m_orders o LEFT JOIN m_items i ON o.order_id = i.order_id LEFT JOIN m_products p ON i.product_id = p.product_id
    LEFT JOIN m_customers c ON o.customer_id = c.customer_id LEFT JOIN m_payments pay ON o.order_id = pay.order_id
  WHERE order_status = 'delivered'"""))(
    lambda s: kpi.kpi_base(s.delivered, s.order_items, s.products, s.customers, s.order_payments)
)
query("kpi_base_summary", on(MODEL, """SELECT count(DISTINCT order_id) AS order_count, min(purchase_ts) AS first_purchase,
  max(purchase_ts) AS last_purchase FROM m_orders WHERE order_status = 'delivered'"""))(
    lambda s: kpi.kpi_base_summary(s.delivered)
)
_RATE = "CASE product_category_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MARGINS.items()) + " ELSE 0.30 END"
query("kpi_margin", on(MODEL, f"""SELECT o.order_id, i.order_item_id, product_category_name, CAST({_RATE} AS DOUBLE) AS margin_rate,
  CAST(price * CAST({_RATE} AS DECIMAL(4,2)) AS DOUBLE) AS gross_profit
  FROM m_orders o LEFT JOIN m_items i ON o.order_id = i.order_id LEFT JOIN m_products p ON i.product_id = p.product_id
  WHERE order_status = 'delivered'"""))(
    lambda s: kpi.kpi_margin(
        s.delivered.select("order_id").join(s.order_items, "order_id", "left").join(s.products, "product_id", "left"),
        MARGINS,
    ).select("order_id", "order_item_id", "product_category_name", "margin_rate", "gross_profit")
)


def sales(s, fanout=False):
    return kpi.sales_lines(s.delivered, s.order_items, s.products, s.order_payments, MARGINS, fanout=fanout)


for _tag, _fan, _text in (("", False, SALES), ("_fanout", True, SALES_FAN)):
    query(f"kpi_monthly_margin{_tag}", on(_text, "SELECT * FROM s_monthly"))(
        lambda s, f=_fan: kpi.kpi_monthly_margin(sales(s, f))
    )
    query(f"kpi_category{_tag}", on(_text, "SELECT * FROM s_category"))(lambda s, f=_fan: kpi.kpi_category(sales(s, f)))
    query(f"kpi_state{_tag}", on(_text, "SELECT * FROM s_state"))(
        lambda s, f=_fan: kpi.kpi_state(sales(s, f), s.customers)
    )
for _by in ("gross_profit", "revenue"):
    query(f"kpi_category_{'profit' if _by == 'gross_profit' else 'revenue'}_top10", on(
        o.sales_tables(False, BRAND), f"SELECT * FROM s_category ORDER BY {_by} DESC, product_category_name LIMIT 10"), BRAND)(
        lambda s, by=_by: kpi.top_categories(kpi.kpi_category(sales(s)), by)
    )
query("kpi_payment", on(MODEL, """, f AS (SELECT p.*, row_number() OVER (PARTITION BY p.order_id, payment_type ORDER BY payment_sequential) AS rn
    FROM m_payments p JOIN m_orders o ON p.order_id = o.order_id WHERE order_status = 'delivered'),
  g AS (SELECT payment_type, count(*) AS transaction_count, CAST(sum(payment_value) AS DOUBLE) AS total_value,
    CAST(sum(payment_installments) AS DOUBLE) / count(*) AS avg_installments FROM f WHERE rn = 1 GROUP BY 1)
  SELECT *, CAST(transaction_count AS DOUBLE) / (SELECT sum(transaction_count) FROM g) AS share FROM g""".lstrip()))(
    lambda s: kpi.kpi_payment(s.order_payments, s.delivered)
)
_INST = """, d AS (SELECT DISTINCT o.order_id, purchase_ts, payment_installments FROM m_orders o JOIN m_payments p
  ON o.order_id = p.order_id WHERE order_status = 'delivered')"""
query("kpi_installments_dist", on(MODEL + _INST, """SELECT payment_installments, count(*) AS orders FROM d
  WHERE payment_installments <= 12 GROUP BY 1"""))(
    lambda s: kpi.kpi_installments_dist(kpi.installment_rows(s.order_payments, s.delivered))
)
query("kpi_installments_monthly", on(MODEL + _INST, """SELECT strftime(purchase_ts, '%Y-%m') AS month,
  CAST(sum(payment_installments) AS DOUBLE) / count(*) AS avg_installments FROM d GROUP BY 1"""))(
    lambda s: kpi.kpi_installments_monthly(kpi.installment_rows(s.order_payments, s.delivered))
)
query("kpi_headline", on(SALES, """SELECT round(sum(gmv), 2) AS total_gmv, CAST(sum(order_count) AS BIGINT) AS total_orders,
  round(avg(aov), 6) AS avg_aov, (SELECT month FROM s_monthly ORDER BY gmv DESC, month LIMIT 1) AS peak_month,
  (SELECT string_agg(product_category_name, ',' ORDER BY revenue DESC, product_category_name) FROM (
    SELECT * FROM s_category ORDER BY revenue DESC, product_category_name LIMIT 3)) AS top_categories FROM s_monthly"""))(
    lambda s: kpi.kpi_headline(kpi.kpi_monthly_margin(sales(s)), kpi.kpi_category(sales(s)))
)
query("kpi_report_months", on(SALES, """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY month) - 1 AS place FROM s_monthly)
  WHERE place IN (4, 8, 12, 16, 20, 23)"""))(lambda s: kpi.kpi_report_months(kpi.kpi_monthly_margin(sales(s))))


# --- reviews ---------------------------------------------------------------------------------

def lines(s, by=(), products=False, texts=False):
    source = s.order_reviews if texts else s.review_scores
    return reviews.review_lines(
        source, s.orders, s.order_items, by, s.products if products else None,
        extra=("review_comment_message",) if texts else (),
    )


query("review_base", on(REVIEWS, "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM r_base"))(
    lambda s: reviews.review_base(s.order_reviews, s.orders, s.order_items, s.products, s.customers)
)
query("score_group", on(MODEL, """SELECT review_id, CASE WHEN review_score <= 2 THEN 'low' WHEN review_score >= 4 THEN 'high'
  ELSE 'mid' END AS score_group FROM m_reviews"""))(
    lambda s: s.review_scores.select("review_id", reviews.score_group(F.col("review_score")).alias("score_group"))
)
query("review_group_counts", on(REVIEWS, """SELECT score_group, count(*) AS reviews,
  count(CASE WHEN trim(review_comment_message, ' \t\r\n') <> '' THEN 1 END) AS with_comment FROM r_base GROUP BY 1"""))(
    lambda s: reviews.review_group_counts(lines(s, texts=True))
)
_MEAN = "CAST(sum({0}) AS DOUBLE) / nullif(count({0}), 0)"
query("review_logistics", on(REVIEWS, f"""SELECT score_group, {_MEAN.format('delivery_days')} AS avg_delivery_days,
  {_MEAN.format('is_delayed')} AS delay_rate,
  {_MEAN.format('CASE WHEN is_delayed = 1 THEN delay_days END')} AS avg_delay_when_delayed
  FROM r_base WHERE score_group IN ('low', 'high') GROUP BY 1"""))(lambda s: reviews.review_logistics(lines(s)))
for _key, _col, _fn in (
    ("review_category_rate", "product_category_name",
     lambda s: reviews.low_rate(lines(s, ("product_category_name",), True), "product_category_name")),
    ("review_state_rate", "customer_state", lambda s: reviews.review_state_rate(lines(s), s.customers)),
):
    query(_key, on(REVIEWS, f"""SELECT {_col}, CAST(count(CASE WHEN score_group = 'low' THEN 1 END) AS DOUBLE) / count(*) AS low_rate,
      count(*) AS reviews FROM r_base WHERE {_col} IS NOT NULL GROUP BY 1"""))(_fn)
query("review_amount", on(REVIEWS, """SELECT score_group, CAST(sum(price) AS DOUBLE) / count(price) AS avg_price FROM r_base
  WHERE score_group IN ('low', 'high') GROUP BY 1"""))(lambda s: reviews.review_amount(lines(s)))
query("review_seller_top10", on(REVIEWS, """, t AS (SELECT seller_id, count(*) AS n FROM r_base WHERE score_group = 'low'
    AND seller_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, seller_id LIMIT 10),
  a AS (SELECT count(*) AS total_low FROM r_base WHERE score_group = 'low')
  SELECT count(*) AS sellers, CAST(sum(n) AS BIGINT) AS top_low, max(total_low) AS total_low,
    CAST(sum(n) AS DOUBLE) / max(total_low) AS share FROM t CROSS JOIN a""".lstrip()))(
    lambda s: reviews.review_seller_top(lines(s, ("seller_id",)))
)
_BRAND_REVIEWS = o.review_tables(BRAND)


@query("review_chi2", on(_BRAND_REVIEWS, """, t AS (SELECT product_category_name AS c, count(*) AS n,
    count(CASE WHEN score_group = 'low' THEN 1 END) AS lows FROM r_base WHERE product_category_name IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, c LIMIT 20),
  x AS (SELECT c, n, unnest([lows, n - lows]) AS seen, unnest([1, 0]) AS k FROM t),
  e AS (SELECT c, k, seen, CAST(n AS DOUBLE) * sum(seen) OVER (PARTITION BY k) / sum(seen) OVER () AS expected FROM x)
  SELECT round(sum((seen - expected) * (seen - expected) / expected), 6) AS chi2,
    (count(DISTINCT c) - 1) * (count(DISTINCT k) - 1) AS dof FROM e WHERE expected > 0""".lstrip()), BRAND)
def _(s):
    rows = lines(s, ("product_category_name",), True)
    return reviews.review_chi2(rows).select(F.round("chi2", 6).alias("chi2"), "dof")


query("review_chi2_p", category=BRAND)(
    lambda s: reviews.review_chi2(lines(s, ("product_category_name",), True))
)


@query("review_mwu", on(REVIEWS, """, d AS (SELECT score_group, delivery_days FROM r_base WHERE delivery_days IS NOT NULL
    AND score_group IN ('low', 'high')),
  k AS (SELECT score_group, CAST(rank() OVER (ORDER BY delivery_days) AS DOUBLE)
    + (count(*) OVER (PARTITION BY delivery_days) - 1) / 2.0 AS mid FROM d),
  b AS (SELECT count(CASE WHEN score_group = 'low' THEN 1 END) AS n1, count(CASE WHEN score_group = 'high' THEN 1 END) AS n2,
    CAST(sum(CASE WHEN score_group = 'low' THEN mid END) AS DOUBLE) AS r1 FROM k),
  g AS (SELECT CAST(sum(CAST(t AS DOUBLE) * t * t - t) AS DOUBLE) AS ties FROM (SELECT count(*) AS t FROM d GROUP BY delivery_days))
  SELECT n1 AS n_low, n2 AS n_high, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u,
    round((r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 - CAST(n1 AS DOUBLE) * n2 / 2 - CAST(0.5 AS DOUBLE))
      / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 8) AS z
  FROM b CROSS JOIN g""".lstrip()))
def _(s):
    return reviews.review_mwu(lines(s)).select("n_low", "n_high", "u", F.round("z", 8).alias("z"))


query("review_mwu_p")(lambda s: reviews.review_mwu(lines(s)))
query("review_score_dist", on(REVIEWS, "SELECT review_score, count(*) AS reviews FROM r_base GROUP BY 1"))(
    lambda s: reviews.review_score_dist(s.review_scores, lines(s))
)
query("review_heatmap", on(REVIEWS, f""", m AS (SELECT score_group, {_MEAN.format('delivery_days')} AS delivery_days,
    {_MEAN.format('is_delayed')} AS delay_rate, CAST(sum(price) AS DOUBLE) / count(price) AS price
    FROM r_base WHERE score_group IN ('low', 'high') GROUP BY 1)
  SELECT *, {", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + CAST(1e-8 AS DOUBLE)) AS {c}_scaled"
    for c in ("delivery_days", "delay_rate", "price"))} FROM m""".lstrip()))(lambda s: reviews.review_heatmap(lines(s)))


def counted_words(s):
    return keywords.keyword_counts(keywords.review_tokens(lines(s, texts=True)))


query("review_tokens", on(REVIEWS, "SELECT review_id, score_group, word, count(*) AS n FROM r_words GROUP BY 1, 2, 3"))(
    lambda s: keywords.review_words(lines(s, texts=True))
)
query("keyword_top50", on(REVIEWS, "SELECT score_group, word, n, place FROM r_top"))(
    lambda s: keywords.keyword_top(counted_words(s))
)
query("keyword_compare", on(REVIEWS, "SELECT * FROM r_compare"))(
    lambda s: keywords.keyword_compare(keywords.keyword_top(counted_words(s)))
)
query("keyword_report", on(REVIEWS, """SELECT 'low' AS section, * FROM (SELECT * FROM r_compare WHERE diff_ratio > 0
    ORDER BY diff_ratio DESC, word LIMIT 15)
  UNION ALL SELECT 'high' AS section, * FROM (SELECT * FROM r_compare WHERE diff_ratio < -0.99
    ORDER BY high_score_count DESC, word LIMIT 10)"""))(
    lambda s: keywords.keyword_report(keywords.keyword_compare(keywords.keyword_top(counted_words(s))))
)


# --- exploration -----------------------------------------------------------------------------

def all_tables(s):
    return {name: s.table(name) for name in s.TABLES if name != "category_translation"}


query("eda_table_counts", on(MODEL, """SELECT 'orders' AS table_name, count(*) AS row_count, CAST(8 AS BIGINT) AS column_count FROM m_orders
  UNION ALL SELECT 'order_items', count(*), 7 FROM m_items UNION ALL SELECT 'order_payments', count(*), 5 FROM m_payments
  UNION ALL SELECT 'order_reviews', count(*), 5 FROM m_reviews UNION ALL SELECT 'products', count(*), 4 FROM m_products
  UNION ALL SELECT 'customers', count(*), 5 FROM m_customers UNION ALL SELECT 'sellers', count(*), 4 FROM supplier
  UNION ALL SELECT 'geolocation', count(*), 5 FROM customer"""))(lambda s: explore.eda_table_counts(all_tables(s)))
_ORDER_COLUMNS = """order_id, customer_id, order_status, purchase_ts AS order_purchase_timestamp,
  purchase_ts + INTERVAL 1 HOUR AS order_approved_at, purchase_ts + INTERVAL 1 DAY AS order_delivered_carrier_date,
  delivered_ts AS order_delivered_customer_date, estimated_ts AS order_estimated_delivery_date"""
query("eda_head", on(MODEL, f"SELECT {_ORDER_COLUMNS} FROM m_orders ORDER BY order_id LIMIT 5"))(
    lambda s: explore.eda_head(s.orders, 5, "order_id")
)


def _describe_sql(columns: dict[str, str]) -> str:
    part = lambda c, num: f"""SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS unique,
      (SELECT CAST({c} AS VARCHAR) FROM m_payments WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top,
      (SELECT max(k) FROM (SELECT count(*) AS k FROM m_payments WHERE {c} IS NOT NULL GROUP BY {c})) AS freq,
      {f'round(CAST(sum({c}) AS DOUBLE) / count({c}), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS mean,
      {f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS min,
      {f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS max,
      {f'round(stddev_samp(CAST({c} AS DOUBLE)), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS std,
      {", ".join((f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6)" if num else "CAST(NULL AS DOUBLE)") + f" AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75))},
      '{columns[c]}' AS dtype FROM m_payments"""
    return " UNION ALL ".join(part(c, columns[c] != "string") for c in columns)


query("eda_describe", on(MODEL, _describe_sql(
    {"order_id": "bigint", "payment_sequential": "int", "payment_type": "string", "payment_installments": "int",
     "payment_value": "decimal(18,2)"})))(
    lambda s: explore.eda_describe(s.order_payments)
)
_NULLS = [
    ("orders", "m_orders", {"order_id": "order_id", "customer_id": "customer_id", "order_status": "order_status",
     "order_purchase_timestamp": "purchase_ts", "order_approved_at": "purchase_ts",
     "order_delivered_carrier_date": "purchase_ts", "order_delivered_customer_date": "delivered_ts",
     "order_estimated_delivery_date": "estimated_ts"}),
    ("order_items", "m_items", {c: c for c in ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")}
     | {"shipping_limit_date": "price"}),
    ("order_reviews", "m_reviews", {c: c for c in ("review_id", "order_id", "review_score", "review_comment_message")}
     | {"review_creation_date": "review_id"}),
]
query("eda_nulls", on(MODEL, " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) - count({src}) AS null_count FROM {table}"
    for name, table, cols in _NULLS for c, src in cols.items())))(
    lambda s: explore.eda_nulls({n: s.table(n) for n, _, _ in _NULLS})
)
query("eda_orders_by_month", on(MODEL, "SELECT strftime(purchase_ts, '%Y-%m') AS year_month, count(*) AS orders FROM m_orders GROUP BY 1"))(
    lambda s: explore.eda_orders_by_month(s.orders)
)
_STATES = ", st AS (SELECT customer_state, count(*) AS users FROM m_customers WHERE customer_state IS NOT NULL GROUP BY 1)"
query("eda_state_top", on(MODEL + _STATES, "SELECT * FROM st ORDER BY users DESC, customer_state LIMIT 15"))(
    lambda s: explore.eda_state_top(s.customers)
)
query("eda_state_pie", on(MODEL + _STATES, """SELECT CASE WHEN p <= 5 THEN customer_state ELSE '其他' END AS customer_state,
  CAST(sum(users) AS BIGINT) AS users FROM (SELECT *, row_number() OVER (ORDER BY users DESC, customer_state) AS p FROM st) GROUP BY 1"""))(
    lambda s: explore.eda_state_pie(s.customers)
)
query("eda_status_dist", on(MODEL, "SELECT order_status, count(*) AS orders FROM m_orders GROUP BY 1"))(
    lambda s: explore.eda_status_dist(s.orders)
)
query("eda_delivery_hist", on(MODEL + ",\n", _hist_sql("delivery_days", "m_clean") + """
  SELECT bin, round(lower_edge, 6) AS lower_edge, round(upper_edge, 6) AS upper_edge, n,
    (SELECT median(delivery_days) FROM m_clean) AS median_days FROM delivery_days_bins"""))(
    lambda s: explore.eda_delivery_hist(cleaned(s)).withColumns(
        {"lower_edge": F.round("lower_edge", 6), "upper_edge": F.round("upper_edge", 6)}
    )
)


# --- recoding: the tables carry codes made from their own keys, so that every fixed label is met --

STATE_CODES, CITY_CODES = list(fv.STATE_LABELS), list(fv.CITY_LABELS)
CATEGORY_CODES, PAYMENTS = list(fv.CATEGORY_LABELS), list(fv.PAYMENT_LABELS)


def _at(words, index):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def _sql_at(words, index):
    return f"[{', '.join(chr(39) + w + chr(39) for w in words)}][{index} + 1]"


def _sql_map(mapping, key, default):
    pairs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {key} {pairs} ELSE {default} END"


def coded_customers(s):
    """Customers with state and city codes by key; every fourth city is one without a label of its own."""
    k = F.col("c_custkey")
    city = F.when(k % 4 == 0, F.concat(F.lit("town "), k.cast("string"))).otherwise(
        F.concat(F.lit(" "), F.initcap(_at(CITY_CODES, k % len(CITY_CODES))))
    )
    return s.raw("customer").select(
        k.alias("customer_id"), k.alias("customer_unique_id"), F.lit(0).alias("customer_zip_code_prefix"),
        city.alias("customer_city"),
        F.when(k % 9 != 0, _at(STATE_CODES, F.col("c_nationkey"))).otherwise("ZZ").alias("customer_state"),
    )


_CODED_CUSTOMERS = f"""coded AS (SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 4 = 0 THEN 'town ' || c_custkey ELSE {_sql_at(CITY_CODES, f'c_custkey % {len(CITY_CODES)}')} END AS city,
  CASE WHEN c_custkey % 9 <> 0 THEN {_sql_at(STATE_CODES, 'c_nationkey')} ELSE 'ZZ' END AS state FROM customer)"""
_STATE_SQL = _sql_map(fv.STATE_LABELS, "state", "'未知'")
_CITY_SQL = (
    f"coalesce({_sql_map(fv.CITY_LABELS, 'city', 'NULL')}, {_sql_map(fv.PROVINCE_CAPITALS, _STATE_SQL, 'NULL')}, '未知')"
)

query("recode_dim", on(_CODED_CUSTOMERS, f"SELECT customer_id, {_STATE_SQL} AS customer_state FROM coded"))(
    lambda s: coded_customers(s).select("customer_id", recode.recode_state(F.col("customer_state")).alias("customer_state"))
)
query("recode_dim_table", """SELECT o_orderkey AS order_id, coalesce(r_name, 'none') AS region FROM orders
  LEFT JOIN (SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey
  LEFT JOIN region ON n_regionkey = r_regionkey""")(
    lambda s: recode.recode_dim(
        s.customers.select(F.col("customer_id").alias("order_id"), F.col("customer_state").alias("region")),
        "region",
        s.raw("nation").join(s.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"),
        F.lit("none"),
    )
)


def coded_products(s):
    k = F.col("p_partkey")
    code = F.when(k % 11 == 0, None).when(k % 13 == 0, "misc").otherwise(_at(CATEGORY_CODES, k % len(CATEGORY_CODES)))
    return s.raw("part").select(k.alias("product_id"), code.alias("product_category_name"))


_CODED_PRODUCTS = f"""coded AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'misc'
  ELSE {_sql_at(CATEGORY_CODES, f'p_partkey % {len(CATEGORY_CODES)}')} END AS code FROM part)"""
_CATEGORY_SQL = f"CASE WHEN code IS NOT NULL THEN {_sql_map(fv.CATEGORY_LABELS, 'code', chr(39) + '其他' + chr(39))} END"
query("recode_category", on(_CODED_PRODUCTS, f"SELECT product_id, {_CATEGORY_SQL} AS product_category_name FROM coded"))(
    lambda s: recode.conform_products(coded_products(s))
)
_PAY_SQL = _sql_map({f: fv.PAYMENT_LABELS[c] for f, c in PAYMENT_CODES.items() if f != "R"}, "payment_type", "'store_credit'")
query("recode_payment", on(MODEL, f"SELECT order_id, payment_sequential, {_PAY_SQL} AS payment_type FROM m_payments"))(
    lambda s: recode.conform_payments(
        s.order_payments.withColumn(
            "payment_type",
            F.when(F.col("payment_type") == "R", "store_credit").otherwise(
                F.when(F.col("payment_type") == "A", PAYMENT_CODES["A"]).otherwise(PAYMENT_CODES["N"])
            ),
        )
    ).select("order_id", "payment_sequential", "payment_type")
)
query("recode_fallback", on(_CODED_CUSTOMERS, f"SELECT customer_id, {_CITY_SQL} AS customer_city FROM coded"))(
    lambda s: coded_customers(s).select(
        "customer_id", recode.recode_city(F.col("customer_city"), F.col("customer_state")).alias("customer_city")
    )
)
_HALF = "CAST(('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), {0}, 16)) AS UBIGINT)"
_HI, _LO = _HALF.format(1), _HALF.format(17)
query("hash_label", f"""SELECT s_suppkey AS seller_id, {_sql_at(fv.SHOP_REGIONS, f'CAST({_LO} % 8 AS BIGINT)')}
  || {_sql_at(fv.SHOP_GOODS, f'CAST(({_LO} // 8) % 16 AS BIGINT)')}
  || {_sql_at(fv.SHOP_KINDS, f'CAST((2 * ({_HI} % 6) + ({_LO} // 128) % 6) % 6 AS BIGINT)')} AS seller_name FROM supplier""")(
    lambda s: s.sellers.select("seller_id", recode.shop_name(F.col("seller_id")).alias("seller_name"))
)


def _sql_hash(salt, key, n):
    return f"(CAST(('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 15)) AS BIGINT) % {n})"


def _sql_text(texts):
    return _sql_at(texts, _sql_hash("42:", "review_id", len(texts)))


query("score_template", on(MODEL, f"""SELECT review_id, CASE WHEN coalesce(trim(review_comment_message, ' \t\r\n'), '') = '' THEN ''
  WHEN review_score >= 4 THEN {_sql_text(fv.POSITIVE_COMMENTS)} WHEN review_score = 3 THEN {_sql_text(fv.NEUTRAL_COMMENTS)}
  ELSE {_sql_text(fv.NEGATIVE_COMMENTS)} END AS review_comment_message, '' AS review_comment_title FROM m_reviews"""))(
    lambda s: recode.conform_reviews(s.order_reviews).select("review_id", "review_comment_message", "review_comment_title")
)
query("synth_zip", f"SELECT c_custkey AS customer_id, 100000 + {_sql_hash('zip42:', 'c_custkey', 900000)} AS customer_zip_code_prefix FROM customer")(
    lambda s: recode.conform_customers(coded_customers(s)).select("customer_id", "customer_zip_code_prefix")
)
query("recode_translation", on(_CODED_PRODUCTS, f"""SELECT DISTINCT {_CATEGORY_SQL} AS product_category_name,
  {_CATEGORY_SQL} AS product_category_name_english FROM coded WHERE code IS NOT NULL"""))(
    lambda s: recode.conform_translation(
        coded_products(s).select("product_category_name").filter(F.col("product_category_name").isNotNull())
        .withColumn("product_category_name_english", F.lit("x"))
    ).distinct()
)


@query("conform_all", on(MODEL, """SELECT 'orders' AS table_name, count(*) AS row_count FROM m_orders
  UNION ALL SELECT 'order_items', count(*) FROM m_items UNION ALL SELECT 'order_payments', count(*) FROM m_payments
  UNION ALL SELECT 'order_reviews', count(*) FROM m_reviews UNION ALL SELECT 'products', count(*) FROM m_products
  UNION ALL SELECT 'customers', count(*) FROM m_customers UNION ALL SELECT 'sellers', count(*) FROM supplier
  UNION ALL SELECT 'geolocation', count(*) FROM customer
  UNION ALL SELECT 'category_translation', count(DISTINCT product_category_name) FROM m_products"""))
def _(s):
    """Writes every conformed table and counts the rows that come back."""
    spark, out = s.spark, scratch_path(s.spark, "conformed")
    done = recode.conform_all({n: s.table(n) for n in s.TABLES})
    for name, df in done.items():
        tables.write_parquet(df, f"{out}/{name}")
    back = {n: spark.read.parquet(f"{out}/{n}") for n in done}
    return explore.eda_table_counts(back).select("table_name", "row_count")


# --- sources and sinks: whole tables out and back ----------------------------------------------

@query("src_csv", on(MODEL, f"SELECT {_ORDER_COLUMNS.replace('order_id, customer_id', 'CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id')} FROM m_orders"))
def _(s):
    path = scratch_path(s.spark, "orders-csv")
    tables.write_csv(s.orders, path)
    return tables.read_csv_tables(s.spark, {"orders": path, "sellers": path + "-missing"})["orders"]


@query("src_parquet", on(MODEL, f"SELECT {_ORDER_COLUMNS} FROM m_orders"))
def _(s):
    path = scratch_path(s.spark, "orders-text")
    text = F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
    tables.write_parquet(s.orders.withColumn("order_purchase_timestamp", text), path)
    return tables.read_parquet(s.spark, path)


@query("sink_parquet", on(MODEL, f"SELECT {o._CLEAN_COLUMNS} FROM m_clean"))
def _(s):
    path = scratch_path(s.spark, "orders-clean")
    tables.write_parquet(cleaned(s), path)
    return s.spark.read.parquet(path)


_MONTHLY = "month, gmv, freight_revenue, order_count, gross_profit, aov, gross_margin, gmv_growth"


@query("sink_csv", on(SALES, f"SELECT {_MONTHLY} FROM s_monthly"))
def _(s):
    path = scratch_path(s.spark, "monthly-csv")
    tables.write_csv(kpi.kpi_monthly_margin(sales(s)), path)
    return s.spark.read.schema(
        "month string, gmv double, freight_revenue double, order_count bigint, gross_profit double, aov double, "
        "gross_margin double, gmv_growth double"
    ).csv(path, header=True)


@query("sink_json", on(SALES, f"SELECT {_MONTHLY} FROM s_monthly"))
def _(s):
    path = scratch_path(s.spark, "monthly-json")
    rows = kpi.kpi_monthly_margin(sales(s))
    nested = rows.select("month", F.struct(*[c for c in rows.columns if c != "month"]).alias("totals"))
    tables.write_json(nested, path)
    return s.spark.read.schema(nested.schema).json(path).select("month", "totals.*")


@query("sql_query", on(MODEL, "SELECT order_status, count(*) AS n FROM m_orders WHERE purchase_ts >= TIMESTAMP '1998-01-01' GROUP BY 1"))
def _(s):
    tables.register_views({"cartlens_orders": s.orders})
    return tables.query(
        s.spark,
        "SELECT order_status, count(*) AS n FROM cartlens_orders "
        "WHERE order_purchase_timestamp >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY order_status",
        {"since": "1998-01-01"},
    )


def _saved(s, name):
    table = f"cartlens_{name}"
    tables.save_table(s.table(name), table, "replace", scratch_path(s.spark, table))
    return table


query("load_table", on(MODEL, "SELECT order_id, payment_sequential, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value FROM m_payments"))(
    lambda s: tables.load_table(s.spark, _saved(s, "order_payments"))
)


@query("list_tables", on(MODEL, """SELECT 'cartlens_products' AS table_name, count(*) AS row_count FROM m_products
  UNION ALL SELECT 'cartlens_sellers', count(*) FROM supplier UNION ALL SELECT 'cartlens_customers', count(*) FROM m_customers"""))
def _(s):
    """The saved tables that the catalog lists, each with its row count."""
    mine = {_saved(s, n) for n in ("products", "sellers", "customers")}
    listed = [r["table_name"] for r in tables.list_tables(s.spark).collect() if r["table_name"] in mine]
    return reduce(DataFrame.unionByName, [explore.eda_table_counts({n: tables.load_table(s.spark, n)}) for n in listed]).select("table_name", "row_count")


query("table_info", """SELECT 'order_payments' AS table_name, n AS row_count, CAST(5 AS BIGINT) AS column_count,
  unnest([0, 1, 2, 3, 4]) AS position,
  unnest(['order_id', 'payment_sequential', 'payment_type', 'payment_installments', 'payment_value']) AS column_name,
  unnest(['bigint', 'int', 'string', 'int', 'decimal(18,2)']) AS column_type
  FROM (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem))""")(
    lambda s: tables.table_info(s.order_payments, "order_payments")
)


@query("save_table", on(MODEL, f"""SELECT {_ORDER_COLUMNS} FROM m_orders
  UNION ALL SELECT {_ORDER_COLUMNS} FROM m_orders WHERE order_status = 'delivered'"""))
def _(s):
    spark, rows = s.spark, s.orders
    tables.save_table(rows, "cartlens_appended", "replace", scratch_path(spark, "appended"))
    tables.save_table(rows.filter(F.col("order_status") == "delivered"), "cartlens_appended", "append")
    return tables.load_table(spark, "cartlens_appended")


_KEYED_TABLES = {
    "customers": ("m_customers", "customer_id"), "orders": ("m_orders", "order_id"), "order_items": ("m_items", "order_id, order_item_id"),
    "order_payments": ("m_payments", "order_id, payment_sequential"), "order_reviews": ("m_reviews", "review_id"),
    "products": ("m_products", "product_id"), "sellers": ("supplier", "s_suppkey"),
    "category_translation": ("(SELECT DISTINCT p_type FROM part)", "p_type"),
}


def _key_sql(name: str, source: str, keys: str) -> str:
    missing = " OR ".join(f"{k} IS NULL" for k in keys.split(", "))
    return f"""SELECT '{name}' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count,
    CAST(coalesce(sum(n) FILTER ({missing}), 0) AS BIGINT) AS null_keys,
    count(*) FILTER (NOT ({missing}) AND n > 1) AS duplicate_keys,
    CAST(coalesce(sum(n - 1) FILTER (NOT ({missing})), 0) AS BIGINT) AS surplus_rows
  FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL)"""


@query("key_check", on(MODEL, " UNION ALL ".join(_key_sql(n, *t) for n, t in _KEYED_TABLES.items())))
def _(s):
    """All tables that have a key; repeated places are what geolocation is made of."""
    parts = [tables.key_check(s.table(n), n) for n in _KEYED_TABLES]
    return reduce(DataFrame.unionByName, parts)


# --- the job --------------------------------------------------------------------------------

@query("pipeline_run", on(FEATURES, """SELECT customer_unique_id, f.total_orders, CAST(total_spend AS DOUBLE) AS total_spend, rfm_segment, is_churned
  FROM features f JOIN segments USING (customer_unique_id) JOIN labels_ USING (customer_unique_id)"""))
def _(s):
    """The job's first three steps over a fresh folder, then resumed: the finished steps are not run again."""
    steps = ("clean", "feature", "churn")
    job = Job(s.spark, s, scratch_path(s.spark, "job"), Thresholds(cutoff_date=CUTOFF), steps=steps)
    job.run()
    if job.run(resume=True):
        raise RuntimeError("finished steps were run again")
    people = job.stored("user_features_labelled")
    return people.select("customer_unique_id", "total_orders", F.col("total_spend").cast("double").alias("total_spend"), "rfm_segment", "is_churned")
