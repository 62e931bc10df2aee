"""Business reports: month, category, region, payment, repeat purchase, margin.

Lines shrink to one row per order (or order and category) before they meet the orders, so a
count of distinct orders is a plain count and a much-repeated order key is gone before the join.
With ``fanout=True`` a report counts every line once per payment of its order, as an aggregation
over the orders x items x payments join does; the payment count is a factor, not a join product.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.scalars import MONEY, lookup, month_of, percent, plain_ratio
from cartlens.operators.clean import keep_delivered

_SUM = "decimal(28,2)"
_PROFIT = "decimal(28,4)"


def _num(c: Column) -> Column:
    return c.cast("double")


def kpi_monthly(orders: DataFrame, items: DataFrame) -> DataFrame:
    lines = items.groupBy("order_id").agg(F.sum("price").alias("gmv"), F.sum("freight_value").alias("freight"))
    sold = keep_delivered(orders).select("order_id", month_of(F.col("order_purchase_timestamp")).alias("year_month"))
    n, gmv = F.count(F.lit(1)), F.sum("gmv").cast(_SUM)
    return (
        sold.join(lines, "order_id")
        .groupBy("year_month")
        .agg(
            n.alias("order_count"),
            _num(gmv).alias("gmv"),
            _num(F.sum("freight").cast(_SUM)).alias("total_freight"),
            plain_ratio(gmv, n).alias("aov"),
        )
        .orderBy("year_month")
    )


def kpi_category_top(orders: DataFrame, items: DataFrame, products: DataFrame, top: int = 20) -> DataFrame:
    """Best categories by revenue: a top-k report, planned as a bounded sort."""
    sold = keep_delivered(orders).select("order_id")
    lines = items.select("order_id", "product_id", "seller_id", "price").join(sold, "order_id", "left_semi")
    revenue = F.sum("price").cast(_SUM)
    return (
        lines.join(products.select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            _num(revenue).alias("total_revenue"),
            plain_ratio(revenue, F.count("price")).alias("avg_price"),
            F.count_distinct("seller_id").alias("seller_count"),
        )
        .orderBy(F.desc("total_revenue"), "product_category_name")
        .limit(top)
    )


def _orders_of_people(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return keep_delivered(orders).join(customers.select("customer_id", "customer_unique_id"), "customer_id")


def kpi_repeat_rate(orders: DataFrame, customers: DataFrame) -> DataFrame:
    people = _orders_of_people(orders, customers).groupBy("customer_unique_id").agg(F.count("order_id").alias("n"))
    again, n = F.count_if(F.col("n") > 1), F.count(F.lit(1))
    return people.agg(n.alias("total_users"), again.alias("repeat_users"), percent(again, n).alias("repeat_rate_pct"))


def kpi_payment_share(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Share against all orders that have any payment, delivered or not."""
    per_order = payments.groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("value"),
        F.sum("payment_installments").alias("inst"),
        F.count("payment_installments").alias("inst_n"),
    )
    all_paid = payments.agg(F.count_distinct("order_id")).scalar()
    sold = keep_delivered(orders).select("order_id")
    n = F.count(F.lit(1))
    return (
        per_order.join(sold, "order_id", "left_semi")
        .groupBy("payment_type")
        .agg(
            n.alias("order_count"),
            _num(F.sum("value").cast(_SUM)).alias("total_payment_value"),
            plain_ratio(F.sum("inst"), F.sum("inst_n")).alias("avg_installments"),
        )
        .withColumn("share_pct", percent(F.col("order_count"), all_paid))
        .orderBy(F.desc("order_count"), "payment_type")
    )


def kpi_monthly_repeat(orders: DataFrame, customers: DataFrame) -> DataFrame:
    people = (
        _orders_of_people(orders, customers)
        .groupBy("customer_unique_id", month_of(F.col("order_purchase_timestamp")).alias("year_month"))
        .agg(F.count("order_id").alias("n"))
    )
    again, n = F.count_if(F.col("n") > 1), F.count(F.lit(1))
    return (
        people.groupBy("year_month")
        .agg(
            n.alias("active_users"), again.alias("repeat_in_month"), percent(again, n).alias("monthly_repeat_rate_pct")
        )
        .orderBy("year_month")
    )


# --- the joined base and its reports ---------------------------------------------------------

def kpi_base(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, payments: DataFrame
) -> DataFrame:
    """The wide join itself, one row per delivered order x line x payment."""
    sold = keep_delivered(orders).select("order_id", "customer_id", "order_purchase_timestamp", "order_status")
    return (
        sold.join(items.select("order_id", "product_id", "seller_id", "price", "freight_value"), "order_id", "left")
        .join(
            payments.select("order_id", "payment_type", "payment_installments", "payment_value"), "order_id", "left"
        )
        .join(products.select("product_id", "product_category_name"), "product_id", "left")
        .join(customers.select("customer_id", "customer_state"), "customer_id", "left")
        .select(
            "order_id", "customer_id", "order_purchase_timestamp", "order_status", "product_id", "seller_id",
            "price", "freight_value", "product_category_name", "customer_state", "payment_type",
            "payment_installments", "payment_value",
            month_of(F.col("order_purchase_timestamp")).alias("year_month"),
        )
    )


def kpi_base_summary(orders: DataFrame) -> DataFrame:
    """The base keeps every delivered order, so its summary needs the orders alone."""
    return keep_delivered(orders).agg(
        F.count_distinct("order_id").alias("order_count"),
        F.min("order_purchase_timestamp").alias("first_purchase"),
        F.max("order_purchase_timestamp").alias("last_purchase"),
    )


def margin_rate(category: Column, rates: Mapping[str, float], default: float) -> Column:
    return lookup({k: float(v) for k, v in rates.items()}, category, F.lit(float(default)))


def kpi_margin(base: DataFrame, rates: Mapping[str, float], default: float = 0.30) -> DataFrame:
    """Margin rate by category, with the default for unknown and missing ones, and the profit of each line."""
    rate = margin_rate(F.col("product_category_name"), rates, default)
    profit = F.col("price").cast(MONEY) * rate.cast("decimal(4,2)")
    return base.withColumns({"margin_rate": rate, "gross_profit": profit})


def _weighted(c: str) -> Column:
    return F.sum(F.col(c) * F.col("w"))


def sales_lines(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    payments: DataFrame,
    rates: Mapping[str, float],
    default: float = 0.30,
    fanout: bool = False,
) -> DataFrame:
    """(order, category) totals of delivered orders with profit and the weight ``w`` of each line.

    Orders without lines stay with null totals, as in the left join they come from.
    """
    lines = items.join(products.select("product_id", "product_category_name"), "product_id", "left")
    per_category = lines.groupBy("order_id", "product_category_name").agg(
        F.sum("price").cast("decimal(24,2)").alias("price"),
        F.sum("freight_value").cast("decimal(24,2)").alias("freight"),
        F.count("price").alias("price_n"),
    )
    sold = keep_delivered(orders).select("order_id", "customer_id", "order_purchase_timestamp")
    rows = sold.join(per_category, "order_id", "left")
    if fanout:
        times = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("pays"))
        rows = rows.join(times, "order_id", "left").withColumn(
            "w", F.coalesce("pays", F.lit(1)).cast("decimal(10,0)")
        )
    else:
        rows = rows.withColumn("w", F.lit(1).cast("decimal(10,0)"))
    rate = margin_rate(F.col("product_category_name"), rates, default).cast("decimal(4,2)")
    return rows.select(
        "order_id", "customer_id", "product_category_name", "w", "price_n",
        month_of(F.col("order_purchase_timestamp")).alias("month"),
        (F.col("price") * F.col("w")).cast(_SUM).alias("gmv"),
        (F.col("freight") * F.col("w")).cast(_SUM).alias("freight"),
        (F.col("price") * F.col("w") * rate).cast(_PROFIT).alias("profit"),
    )


def kpi_monthly_margin(lines: DataFrame) -> DataFrame:
    """Month totals, margin and growth; the lag runs over the few month rows."""
    per_order = lines.groupBy("month", "order_id").agg(
        F.sum("gmv").alias("gmv"), F.sum("freight").alias("freight"), F.sum("profit").alias("profit")
    )
    zero = F.lit(0)
    months = per_order.groupBy("month").agg(
        F.coalesce(F.sum("gmv").cast(_SUM), zero).cast(_SUM).alias("gmv"),
        F.coalesce(F.sum("freight").cast(_SUM), zero).cast(_SUM).alias("freight_revenue"),
        F.count(F.lit(1)).alias("order_count"),
        F.coalesce(F.sum("profit").cast(_PROFIT), zero).cast(_PROFIT).alias("gross_profit"),
    )
    before = F.lag("gmv").over(Window.orderBy("month"))
    return months.select(
        "month",
        _num(F.col("gmv")).alias("gmv"),
        _num(F.col("freight_revenue")).alias("freight_revenue"),
        "order_count",
        _num(F.col("gross_profit")).alias("gross_profit"),
        plain_ratio(F.col("gmv"), F.col("order_count")).alias("aov"),
        plain_ratio(F.col("gross_profit"), F.col("gmv")).alias("gross_margin"),
        (plain_ratio(F.col("gmv"), before) - 1.0).alias("gmv_growth"),
    ).orderBy("month")


def kpi_category(lines: DataFrame) -> DataFrame:
    revenue, profit = F.sum("gmv").cast(_SUM), F.sum("profit").cast(_PROFIT)
    return (
        lines.filter(F.col("product_category_name").isNotNull())
        .groupBy("product_category_name")
        .agg(
            _num(revenue).alias("revenue"),
            F.count(F.lit(1)).alias("order_count"),
            _num(profit).alias("gross_profit"),
            plain_ratio(revenue, _weighted("price_n")).alias("avg_price"),
            plain_ratio(profit, revenue).alias("margin_rate"),
        )
        .orderBy(F.desc("revenue"), "product_category_name")
    )


def top_categories(categories: DataFrame, by: str, n: int = 10) -> DataFrame:
    return categories.orderBy(F.desc(by), "product_category_name").limit(n)


def kpi_state(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """Totals per state. ``avg_order_value`` is the mean line price, as its name does not say.

    The per-order customer id makes distinct customers equal to distinct orders of that customer.
    """
    per_order = lines.groupBy("order_id", "customer_id").agg(
        F.sum("gmv").alias("gmv"), F.sum(F.col("price_n") * F.col("w")).alias("lines")
    )
    gmv = F.coalesce(F.sum("gmv").cast(_SUM), F.lit(0).cast(_SUM))
    return (
        per_order.join(customers.select("customer_id", "customer_state"), "customer_id", "left")
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            _num(gmv).alias("gmv"),
            F.count(F.lit(1)).alias("order_count"),
            F.count_distinct("customer_id").alias("customer_count"),
            plain_ratio(gmv, F.sum("lines")).alias("avg_order_value"),
        )
        .orderBy(F.desc("gmv"), "customer_state")
    )


def _first_payment(payments: DataFrame, *keys: str) -> DataFrame:
    """The first payment row per key set by sequence number; ``min_by`` combines before the shuffle."""
    row = F.struct("payment_value", "payment_installments")
    return payments.groupBy("order_id", *keys).agg(F.min_by(row, "payment_sequential").alias("p"))


def kpi_payment(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Transactions by type, one per order and type; the share is of the counted transactions."""
    sold = keep_delivered(orders).select("order_id")
    n = F.count(F.lit(1))
    rows = (
        _first_payment(payments, "payment_type")
        .filter(F.col("payment_type").isNotNull())
        .join(sold, "order_id", "left_semi")
        .groupBy("payment_type")
        .agg(
            n.alias("transaction_count"),
            _num(F.sum("p.payment_value").cast(_SUM)).alias("total_value"),
            plain_ratio(F.sum("p.payment_installments"), F.count("p.payment_installments")).alias("avg_installments"),
        )
    )
    total = rows.agg(F.sum("transaction_count")).scalar()
    return rows.withColumn("share", plain_ratio(F.col("transaction_count"), total)).orderBy(
        F.desc("transaction_count"), "payment_type"
    )


def installment_rows(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Different installment counts per delivered order."""
    sold = keep_delivered(orders).select("order_id", month_of(F.col("order_purchase_timestamp")).alias("month"))
    pairs = payments.select("order_id", "payment_installments").distinct()
    return sold.join(pairs, "order_id").filter(F.col("payment_installments").isNotNull())


def kpi_installments_dist(rows: DataFrame, most: int = 12) -> DataFrame:
    return (
        rows.filter(F.col("payment_installments") <= most)
        .groupBy("payment_installments").agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("payment_installments")
    )


def kpi_installments_monthly(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        rows.groupBy("month")
        .agg(plain_ratio(F.sum("payment_installments"), n).alias("avg_installments"))
        .orderBy("month")
    )


def kpi_headline(monthly: DataFrame, categories: DataFrame) -> DataFrame:
    """Totals, mean order value, best month and best three categories, from the small report tables."""
    best = categories.orderBy(F.desc("revenue"), "product_category_name").limit(3)
    names = best.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("revenue")).alias("k"), F.col("product_category_name").alias("v")))),
            lambda x: x["v"],
        )
    ).scalar()
    return monthly.agg(
        F.round(F.sum("gmv"), 2).alias("total_gmv"),
        F.sum("order_count").alias("total_orders"),
        F.round(F.avg("aov"), 6).alias("avg_aov"),
        F.min_by("month", F.struct(-F.col("gmv"), F.col("month"))).alias("peak_month"),
    ).withColumn("top_categories", F.array_join(names, ","))


def kpi_report_months(monthly: DataFrame, places: tuple[int, ...] = (4, 8, 12, 16, 20, 23)) -> DataFrame:
    """Month rows at fixed places counted from zero; the window covers the few month rows."""
    place = F.row_number().over(Window.orderBy("month")) - 1
    return monthly.withColumn("place", place).filter(F.col("place").isin(*places))
