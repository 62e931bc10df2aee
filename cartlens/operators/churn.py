"""Purchase intervals, the churn threshold they give, and churn labels.

All orders of a person on one calendar day collapse to (first, last, count) before the window, so
the window sees at most one row per person and day however many orders a person has. Gaps inside
a day are zero in both dialects; gaps between days come from the last order of one day and the
first of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.config import SQL, check_dialect
from cartlens.fixed_values import ORDERS_FOUR_UP, ORDERS_ONE, ORDERS_TWO_THREE
from cartlens.functions.scalars import day_difference, flag, percent, plain_ratio
from cartlens.operators.features import PERSON

_CHUNK = 4096


def interval_counts(cleaned: DataFrame, dialect: str = SQL, min_orders: int = 2) -> DataFrame:
    """(person, purchase_interval_days, n): how often each gap between neighbouring orders occurs.

    The sql dialect drops gaps of zero days; the frame dialect keeps them.
    """
    check_dialect(dialect)
    ts = F.col("order_purchase_timestamp")
    days = cleaned.groupBy(PERSON, ts.cast("date").alias("day")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("orders")
    )
    by_day = Window.partitionBy(PERSON).orderBy("day")
    gaps = days.select(
        PERSON,
        "orders",
        day_difference(F.col("first_ts"), F.lag("last_ts").over(by_day), dialect).alias("gap"),
        F.sum("orders").over(Window.partitionBy(PERSON)).alias("person_orders"),
    ).filter(F.col("person_orders") >= min_orders)
    between = F.struct(F.col("gap").alias("purchase_interval_days"), F.lit(1).cast("bigint").alias("n"))
    inside = F.struct(F.lit(0).alias("purchase_interval_days"), (F.col("orders") - 1).alias("n"))
    rows = gaps.select(PERSON, F.inline(F.array(between, inside))).filter(
        F.col("purchase_interval_days").isNotNull() & (F.col("n") > 0)
    )
    if dialect == SQL:
        rows = rows.filter(F.col("purchase_interval_days") > 0)
    return rows.groupBy(PERSON, "purchase_interval_days").agg(F.sum("n").alias("n"))


def purchase_intervals(cleaned: DataFrame, dialect: str = SQL, min_orders: int = 2) -> DataFrame:
    """One row per gap. Repeats are unrolled in short runs, so no long array is ever built."""
    counted = interval_counts(cleaned, dialect, min_orders)
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _CHUNK))))
    length = F.least(F.lit(_CHUNK), F.col("n") - F.col("run") * _CHUNK).cast("int")
    return runs.select(
        PERSON, F.explode(F.array_repeat("purchase_interval_days", length)).alias("purchase_interval_days")
    )


def interval_histogram(counted: DataFrame) -> DataFrame:
    """Occurrences per gap length: as many rows as there are different day counts."""
    return counted.groupBy("purchase_interval_days").agg(F.sum("n").alias("n"))


def churn_threshold(counted: DataFrame, p: float = 0.75, multiplier: float = 2.0) -> DataFrame:
    """Frame dialect: linearly interpolated quantile of the gaps, times the multiplier."""
    hist = interval_histogram(counted)
    q = F.percentile("purchase_interval_days", F.lit(p), F.col("n"))
    return hist.agg(q.alias("p75_interval"), (q * F.lit(float(multiplier))).alias("churn_threshold"))


def churn_threshold_sql(counted: DataFrame, p: float = 0.75, multiplier: float = 2.0) -> DataFrame:
    """Sql dialect: the smallest gap whose PERCENT_RANK reaches ``p``, from the day histogram."""
    hist = interval_histogram(counted)
    upto = Window.orderBy("purchase_interval_days").rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.select(
        "purchase_interval_days",
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    share = F.col("before") / F.greatest(F.col("total") - 1, F.lit(1))
    return ranked.filter(share >= p).agg(
        F.min("purchase_interval_days").alias("p75_interval"),
        (F.min("purchase_interval_days") * F.lit(multiplier)).alias("churn_threshold"),
    )


def churn_labels(features: DataFrame, threshold: DataFrame) -> DataFrame:
    """Every person, single buyers too: churned when the last purchase is longer ago than the threshold."""
    limit = threshold.select("churn_threshold").scalar()
    return features.select(
        PERSON,
        "recency_days",
        "total_orders",
        limit.alias("churn_threshold"),
        F.col("recency_days").alias("days_since_last"),
        flag(F.col("recency_days") > limit).alias("is_churned"),
    )


def churn_writeback(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``is_churned``; an older one is replaced, so a second run gives the same table."""
    return features.drop("is_churned").join(labels.select(PERSON, "is_churned"), PERSON, "left")


def churn_summary(labels: DataFrame) -> DataFrame:
    n, gone = F.count(F.lit(1)), F.sum("is_churned")
    return labels.agg(
        F.max("churn_threshold").alias("churn_threshold_days"),
        n.alias("total_users"),
        gone.alias("churned_users"),
        percent(gone, n).alias("churn_rate_pct"),
    )


def order_group() -> Column:
    n = F.col("total_orders")
    return F.when(n == 1, ORDERS_ONE).when(n.between(2, 3), ORDERS_TWO_THREE).otherwise(ORDERS_FOUR_UP)


def churn_by_order_group(labels: DataFrame) -> DataFrame:
    n, gone = F.count(F.lit(1)), F.sum("is_churned")
    return (
        labels.groupBy(order_group().alias("order_group"))
        .agg(n.alias("user_count"), gone.alias("churned"), percent(gone, n).alias("churn_rate_pct"))
        .orderBy(F.desc("churn_rate_pct"), "order_group")
    )


def churn_single_vs_multi(labels: DataFrame, counted: DataFrame, min_orders: int = 2) -> DataFrame:
    """Churn of one-time and returning buyers beside mean, median and upper quartile of the gaps."""
    one, more = F.col("total_orders") == 1, F.col("total_orders") >= min_orders
    gone = F.col("is_churned") == 1
    rate = lambda who: F.coalesce(plain_ratio(F.count_if(who & gone), F.count_if(who)), F.lit(0.0))
    gaps = interval_histogram(counted).agg(
        F.struct(
            plain_ratio(F.sum(F.col("purchase_interval_days") * F.col("n")), F.sum("n")).alias("mean"),
            F.percentile("purchase_interval_days", F.lit(0.5), F.col("n")).alias("median"),
            F.percentile("purchase_interval_days", F.lit(0.75), F.col("n")).alias("p75"),
        ).alias("s")
    ).scalar()
    people = labels.agg(
        F.count_if(one).alias("single_users"),
        rate(one).alias("single_churn_rate"),
        F.count_if(more).alias("multi_users"),
        rate(more).alias("multi_churn_rate"),
    )
    return people.select(
        "*", gaps["mean"].alias("interval_mean"), gaps["median"].alias("interval_median"), gaps["p75"].alias("interval_p75")
    )
