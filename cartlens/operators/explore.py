"""First looks at tables: sizes, samples, column profiles, small distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.fixed_values import REST_LABEL
from cartlens.functions.scalars import month_of
from cartlens.operators.ordered import equal_width_bins, running_totals
from cartlens.session import written


def eda_table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
    )
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def eda_head(df: DataFrame, n: int = 5, order: str | None = None) -> DataFrame:
    return (df.orderBy(order) if order else df).limit(n)


def eda_describe(df: DataFrame) -> DataFrame:
    """Type, count, distinct values, most frequent value, mean, deviation, extremes and quartiles per column.

    Value counts come from one stacked (column, value) aggregation, so the mode of a column never
    needs all its values in one buffer. Quartiles are found in the counts: one running total over all columns in
    order of column and number, in which a wanted place lies at the first number whose total reaches it.
    """
    kinds = dict(df.dtypes)
    numeric = {c for c, k in kinds.items() if k.startswith(("int", "bigint", "double", "float", "decimal", "smallint"))}
    pairs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).cast("string").alias("value"),
            (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"),
        )
        for c in df.columns
    ]
    counts = (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.max("num").alias("num"))
    )
    counts = written(counts, "value-counts")
    seen = F.when(F.col("value").isNotNull(), F.col("n"))
    total, mean = F.sum(seen), F.sum(F.col("num") * F.col("n")) / F.nullif(F.sum(F.when(F.col("num").isNotNull(), F.col("n"))), F.lit(0))
    types = F.create_map(*[part for c, k in kinds.items() for part in (F.lit(c), F.lit(k))])
    centre = counts.filter("num is not null").groupBy("column_name").agg((F.sum(F.col("num") * F.col("n")) / F.sum("n")).alias("centre"))
    off = F.col("num") - F.col("centre")
    spread = counts.filter("num is not null").join(F.broadcast(centre), "column_name").groupBy("column_name").agg(
        F.round(F.sqrt(F.sum(F.col("n") * off * off) / F.nullif(F.sum("n") - 1, F.lit(0))), 6).alias("std"))
    main = counts.groupBy("column_name").agg(
        F.coalesce(total, F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(seen).alias("freq"),
        F.round(mean, 6).alias("mean"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
    ).withColumn("dtype", F.element_at(types, F.col("column_name")))
    shape = spread.join(_quartiles(counts), "column_name")
    return main.join(F.broadcast(shape), "column_name", "left").select(
        "column_name", "count", "unique", "top", "freq", "mean", "min", "max", "std", "p25", "p50", "p75", "dtype")


def _quartiles(counts: DataFrame) -> DataFrame:
    """column_name, p25, p50, p75: interpolated between places, from rows (column_name, num, n)."""
    numbers = counts.filter("num is not null").groupBy("column_name", "num").agg(F.sum("n").alias("n"))
    line = running_totals(numbers, ["column_name", "num"], {"upto": "n"})
    groups = numbers.groupBy("column_name").agg(F.sum("n").alias("rows"))
    starts = line.groupBy("column_name").agg(F.min(F.col("upto") - F.col("n")).alias("start"))
    placed = line.join(F.broadcast(groups.join(starts, "column_name")), "column_name").withColumn("last", F.col("upto") - F.col("start"))
    picks = []
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        at = (F.col("rows") - 1) * F.lit(p)
        reached = lambda place: F.min(F.when(F.col("last") >= place, F.col("num")))
        picks += [reached(F.floor(at) + 1).alias(f"lo_{name}"), reached(F.ceil(at) + 1).alias(f"hi_{name}"), F.max(at - F.floor(at)).alias(f"at_{name}")]
    return placed.groupBy("column_name").agg(*picks).select(
        "column_name", *[F.round(F.col(f"lo_{n}") + F.col(f"at_{n}") * (F.col(f"hi_{n}") - F.col(f"lo_{n}")), 6).alias(n) for n in ("p25", "p50", "p75")])


def eda_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    from cartlens.operators.features import missing_profile

    parts = [
        missing_profile(df).select(F.lit(name).alias("table_name"), "column_name", "null_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def eda_orders_by_month(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("order_purchase_timestamp").isNotNull())
        .groupBy(month_of(F.col("order_purchase_timestamp")).alias("year_month"))
        .agg(F.count(F.lit(1)).alias("orders")).orderBy("year_month")
    )


def count_by(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def eda_state_top(customers: DataFrame, top: int = 15) -> DataFrame:
    return (
        count_by(customers.filter(F.col("customer_state").isNotNull()), "customer_state", "users")
        .orderBy(F.desc("users"), "customer_state").limit(top)
    )


def eda_state_pie(customers: DataFrame, top: int = 5) -> DataFrame:
    """The largest states and one row for the rest; the window covers one row per state."""
    states = count_by(customers.filter(F.col("customer_state").isNotNull()), "customer_state", "users")
    place = F.row_number().over(Window.orderBy(F.desc("users"), "customer_state"))
    label = F.when(F.col("place") <= top, F.col("customer_state")).otherwise(REST_LABEL)
    return states.withColumn("place", place).groupBy(label.alias("customer_state")).agg(F.sum("users").alias("users"))


def eda_status_dist(orders: DataFrame) -> DataFrame:
    return count_by(orders, "order_status", "orders").orderBy(F.desc("orders"), "order_status")


def eda_delivery_hist(cleaned: DataFrame, bins: int = 50) -> DataFrame:
    """Bins of whole delivery days; the median comes from the few different day values."""
    middle = cleaned.agg(F.percentile("delivery_days", 0.5)).scalar()
    return equal_width_bins(cleaned, "delivery_days", bins).withColumn("median_days", middle)
