"""Recency, frequency, money: quartile scores, segments and their reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.fixed_values import (
    MANUAL_GENERAL, MANUAL_GROWING, MANUAL_KEY, MANUAL_LOST,
    SEGMENT_AT_RISK, SEGMENT_HIGH_VALUE, SEGMENT_KEEP, SEGMENT_WAKE,
)
from cartlens.functions.scalars import percent, plain_ratio
from cartlens.operators import selection
from cartlens.operators.features import PERSON
from cartlens.operators.ordered import equal_width_bins, exact_quantiles


def _scores(
    features: DataFrame, measures: dict[str, Column], ends: Callable[[int, int], list[int]], bins: int
) -> dict[str, Column]:
    """Each measure's bin of a row, from 1, by comparing it with the rows at the bins' last places.

    Order is (value, person) with nulls first. Only the few cut rows are selected; no row is ranked or moved.
    """
    order = {m: c.cast("double") for m, c in measures.items()}
    pairs = [F.struct(F.lit(m).alias("measure"), c.alias("value")) for m, c in order.items()]
    stacked = features.select(PERSON, F.inline(F.array(*pairs)))
    keys = lambda value: [value.isNotNull(), F.coalesce(value, F.lit(0.0)), F.col(PERSON)]
    total = features.count()
    sizes = {(m,): total for m in measures} if total else {}
    wanted = {g: {r for r in ends(n, bins) if r} for g, n in sizes.items()}
    cuts = selection.rows_at(stacked, keys(F.col("value")), wanted, sizes, ["measure"])
    return {
        m: sum(
            (selection.above(cuts[(m,), r], keys(c)).cast("int") for r in ends(total, bins) if r and total), F.lit(1)
        )
        for m, c in order.items()
    }


def rfm_ntile(features: DataFrame, bins: int = 4) -> DataFrame:
    """NTILE scores: recency from the longest to the shortest, frequency and money upwards, ties by person."""
    scores = _scores(
        features,
        {"r": -F.col("recency_days"), "f": F.col("purchase_frequency"), "m": F.col("total_spend")},
        selection.ntile_ends, bins,
    )
    return features.select(PERSON, *[scores[m].alias(f"rfm_{m}_score") for m in "rfm"])


def rfm_qcut(features: DataFrame, bins: int = 4) -> DataFrame:
    """Quantile cut of first-come ranks, ties by person; recency counts down."""
    up = _scores(
        features,
        {"r": F.col("recency_days"), "f": F.col("purchase_frequency"), "m": F.col("total_spend")},
        selection.quantile_ends, bins,
    )
    return features.select(
        PERSON, (bins + 1 - up["r"]).alias("rfm_r_score"), up["f"].alias("rfm_f_score"), up["m"].alias("rfm_m_score")
    )


def segment_label() -> Column:
    r, f, m = F.col("rfm_r_score"), F.col("rfm_f_score"), F.col("rfm_m_score")
    recent = r >= 3
    return (
        F.when(recent & (f >= 3) & (m >= 3), SEGMENT_HIGH_VALUE)
        .when(recent & ((f >= 2) | (m >= 3)), SEGMENT_KEEP)
        .when((r <= 2) & (f >= 2), SEGMENT_WAKE)
        .otherwise(SEGMENT_AT_RISK)
    )


def rfm_segment(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rfm_segment", segment_label())


def with_rfm(features: DataFrame, dialect: str = "sql", bins: int = 4) -> DataFrame:
    scores = rfm_ntile(features, bins) if dialect == "sql" else rfm_qcut(features, bins)
    return features.join(rfm_segment(scores), PERSON, "left")


def rfm_distribution(segmented: DataFrame) -> DataFrame:
    """Persons and share per segment; the total comes from the few segment rows."""
    counts = segmented.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("user_count"))
    total = counts.agg(F.sum("user_count")).scalar()
    return counts.withColumn("pct", percent(F.col("user_count"), total)).orderBy(F.desc("user_count"), "rfm_segment")


def rfm_manual(features: DataFrame) -> DataFrame:
    """Summed quartile scores: recency by value edges, orders and money by first-come ranks."""
    edges = features.agg(F.percentile("recency_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e")).scalar()
    up = _scores(features, {"f": F.col("total_orders"), "m": F.col("total_spend")}, selection.quantile_ends, 4)
    days = F.col("recency_days")
    r = (
        F.when(days <= edges.getItem(0), 4)
        .when(days <= edges.getItem(1), 3)
        .when(days <= edges.getItem(2), 2)
        .otherwise(1)
    )
    points = F.col("rfm_total")
    label = (
        F.when(points >= 10, MANUAL_KEY).when(points >= 8, MANUAL_GROWING)
        .when(points >= 6, MANUAL_GENERAL).otherwise(MANUAL_LOST)
    )
    return (
        features.select(PERSON, r.alias("r_score"), up["f"].alias("f_score"), up["m"].alias("m_score"))
        .withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score"))
        .withColumn("rfm_segment", label)
    )


def segment_profile(labelled: DataFrame, segment: str = "rfm_segment") -> DataFrame:
    """Means of the main measures, persons and their share per segment."""
    n = F.count(F.lit(1))
    rows = labelled.groupBy(segment).agg(
        plain_ratio(F.sum("total_spend"), n).alias("avg_spend"),
        plain_ratio(F.sum("total_orders"), n).alias("avg_orders"),
        plain_ratio(F.sum("recency_days"), n).alias("avg_recency"),
        plain_ratio(F.sum("is_churned"), n).alias("churn_rate"),
        n.alias("user_count"),
    )
    total = rows.agg(F.sum("user_count")).scalar()
    return rows.withColumn("user_share", plain_ratio(F.col("user_count"), total))


MEASURES = ("total_spend", "total_orders", "recency_days")
BOX = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def segment_box(labelled: DataFrame, segment: str = "rfm_segment") -> DataFrame:
    """Box-plot numbers of each measure per segment with the segment's place by descending mean."""
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES]
    stacked = labelled.select(PERSON, segment, F.inline(F.array(*pairs)))
    boxes = exact_quantiles(stacked, "value", BOX, within=["measure", segment])
    money = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("decimal(28,2)").alias("value")) for m in MEASURES]
    means = (
        labelled.select(segment, F.inline(F.array(*money)))
        .groupBy("measure", segment)
        .agg(plain_ratio(F.sum("value"), F.count("value")).alias("mean"))
    )
    return boxes.join(means, ["measure", segment])


def rfm_histogram(features: DataFrame, measure: str, bins: int = 50) -> DataFrame:
    """Equal-width counts of one measure with its exact median on every row."""
    data = features.select(PERSON, F.col(measure).cast("double").alias(measure))
    middle = exact_quantiles(data, measure, {"median": 0.5}).scalar()
    return equal_width_bins(data, measure, bins).select(
        F.lit(measure).alias("measure"), "bin", "lower_edge", "upper_edge", "n", middle.alias("median")
    )
