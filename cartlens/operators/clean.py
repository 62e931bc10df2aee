"""Order cleaning: filter, parse, drop, join to the person, delivery days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.config import SQL, check_dialect
from cartlens.fixed_values import FUNNEL_STAGES
from cartlens.functions.scalars import day_difference, exact_ratio, percent, plain_ratio

TIME_COLUMNS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
REQUIRED = ("order_id", "customer_id", "order_purchase_timestamp")


def keep_delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == "delivered")


def parse_times(orders: DataFrame, columns: tuple[str, ...] = TIME_COLUMNS) -> DataFrame:
    """Text to timestamps; unreadable text becomes null. Timestamp columns pass unchanged."""
    kinds = dict(orders.dtypes)
    changed = {
        c: F.col(c).try_cast("timestamp_ntz") for c in columns if kinds.get(c) == "string"
    }
    return orders.withColumns(changed) if changed else orders


def drop_incomplete(orders: DataFrame) -> DataFrame:
    return orders.na.drop(subset=list(REQUIRED))


def add_person(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders whose customer is known, with the person behind the per-order customer id."""
    keys = customers.select("customer_id", "customer_unique_id").filter(F.col("customer_unique_id").isNotNull())
    return orders.join(keys, "customer_id")


def add_delivery_days(orders: DataFrame, dialect: str = SQL) -> DataFrame:
    check_dialect(dialect)
    arrived = F.col("order_delivered_customer_date")
    return orders.withColumns(
        {
            "delivery_days": day_difference(arrived, F.col("order_purchase_timestamp"), dialect),
            "delivery_delay_days": day_difference(arrived, F.col("order_estimated_delivery_date"), dialect),
        }
    )


def orders_clean(orders: DataFrame, customers: DataFrame, dialect: str = SQL) -> DataFrame:
    """Delivered orders of known persons with delivery days.

    The sql dialect counts calendar days and drops orders without arrival or with negative days;
    the frame dialect counts whole 24-hour units and keeps both.
    """
    ready = drop_incomplete(parse_times(keep_delivered(orders)))
    if dialect == SQL:
        ready = ready.filter(F.col("order_delivered_customer_date").isNotNull())
    cleaned = add_delivery_days(add_person(ready, customers), dialect)
    if dialect == SQL:
        cleaned = cleaned.filter(F.col("delivery_days") >= 0)
    return cleaned.select(
        "order_id", "customer_id", "customer_unique_id", "order_status", *TIME_COLUMNS,
        "delivery_days", "delivery_delay_days",
    )


def latest_per_order(orders: DataFrame) -> DataFrame:
    """One row per order_id, the latest purchase.

    ``max_by`` keeps one row per key already before the shuffle, so a much-copied order costs nothing.
    """
    rest = [c for c in orders.columns if c != "order_id"]
    row = F.struct(*rest)
    age = F.struct("order_purchase_timestamp", *[c for c in rest if c != "order_purchase_timestamp"])
    return orders.groupBy("order_id").agg(F.max_by(row, age).alias("_r")).select("order_id", "_r.*").select(
        *orders.columns
    )


def clean_quality(cleaned: DataFrame) -> DataFrame:
    """One row of checks over the cleaned orders."""
    late = F.count_if(F.col("delivery_delay_days") > 0)
    return cleaned.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct("customer_unique_id").alias("unique_users"),
        F.min("order_purchase_timestamp").alias("earliest_order"),
        F.max("order_purchase_timestamp").alias("latest_order"),
        exact_ratio(F.sum("delivery_days"), F.count("delivery_days"), 1).alias("avg_delivery_days"),
        exact_ratio(F.sum("delivery_delay_days"), F.count("delivery_delay_days"), 1).alias("avg_delay_days"),
        percent(late, F.count(F.lit(1))).alias("delayed_pct"),
    )


def clean_funnel(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows left after each cleaning stage, their share of all, and the median delivery days of the last.

    One pass: every stage is a conditional count over the same scan.
    """
    delivered = F.col("order_status") == "delivered"
    complete = delivered
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    known = customers.select("customer_id", "customer_unique_id").filter(F.col("customer_unique_id").isNotNull())
    rows = add_delivery_days(parse_times(orders), "frame").join(known, "customer_id", "left")
    final = complete & F.col("customer_unique_id").isNotNull()
    totals = rows.agg(
        F.array(
            F.count(F.lit(1)), F.count_if(delivered), F.count_if(complete), F.count_if(final)
        ).alias("counts"),
        F.percentile(F.when(final, F.col("delivery_days")), 0.5).alias("median_days"),
    )
    names = F.array(*[F.lit(s) for s in FUNNEL_STAGES])
    return totals.select(F.posexplode("counts").alias("pos", "orders"), "counts", "median_days").select(
        (F.col("pos") + 1).alias("step"),
        F.element_at(names, F.col("pos") + 1).alias("stage"),
        F.col("orders"),
        plain_ratio(F.col("orders"), F.element_at("counts", 1)).alias("retained_ratio"),
        F.when(F.col("pos") == len(FUNNEL_STAGES) - 1, F.col("median_days")).alias("median_delivery_days"),
    )
