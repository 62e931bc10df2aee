"""What low scores go with: delivery, category, region, price, seller, and two tests."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.scalars import elapsed_days, flag, not_blank, plain_ratio
from cartlens.functions.tails import chi2_tail, rank_sum_tail

_SUM = "decimal(28,2)"
LOW, HIGH, MID = "low", "high", "mid"


def score_group(score: Column, low: int = 2, high: int = 4) -> Column:
    """Low up to ``low``, high from ``high``, everything else and unknown scores in the middle."""
    return F.when(score <= low, LOW).when(score >= high, HIGH).otherwise(MID)


def _with_order(reviews: DataFrame, orders: DataFrame, low: int, extra: tuple[str, ...] = ()) -> DataFrame:
    arrived = F.col("order_delivered_customer_date")
    dated = orders.select(
        "order_id", "customer_id",
        elapsed_days(arrived, F.col("order_purchase_timestamp")).alias("delivery_days"),
        elapsed_days(arrived, F.col("order_estimated_delivery_date")).alias("delay_days"),
    )
    return (
        reviews.select("review_id", "order_id", "review_score", *extra)
        .join(dated, "order_id", "left")
        .withColumns(
            {"is_delayed": flag(F.col("delay_days") > 0), "score_group": score_group(F.col("review_score"), low)}
        )
    )


def review_base(
    reviews: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame, low: int = 2
) -> DataFrame:
    """One row per review and line of its order."""
    return (
        _with_order(reviews, orders, low, ("review_comment_message",))
        .join(items.select("order_id", "product_id", "seller_id", "price"), "order_id", "left")
        .join(products.select("product_id", "product_category_name"), "product_id", "left")
        .join(customers.select("customer_id", "customer_state"), "customer_id", "left")
        .select(
            "review_id", "order_id", "review_score", "review_comment_message", "customer_id", "product_id",
            "seller_id", "price", "product_category_name", "customer_state", "delivery_days", "delay_days",
            "is_delayed", "score_group",
        )
    )


def review_lines(
    reviews: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    by: tuple[str, ...] = (),
    products: DataFrame | None = None,
    low: int = 2,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """The base with equal lines folded: ``w`` lines, their price sum and count, per review and ``by``.

    Lines are folded per order before the join, so an order with very many lines stays one row.
    """
    lines = items
    if products is not None:
        lines = items.join(products.select("product_id", "product_category_name"), "product_id", "left")
    folded = lines.groupBy("order_id", *by).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("price").alias("price_sum"), F.count("price").alias("price_n")
    )
    return (
        _with_order(reviews, orders, low, extra)
        .join(folded, "order_id", "left")
        .withColumn("w", F.coalesce("lines", F.lit(1)))
    )


def review_group_counts(rows: DataFrame) -> DataFrame:
    """Rows per score group and how many of them carry a comment."""
    text = F.when(not_blank(F.col("review_comment_message")), F.col("w")).otherwise(0)
    return rows.groupBy("score_group").agg(F.sum("w").alias("reviews"), F.sum(text).alias("with_comment"))


def _mean(c: Column, w: Column = None) -> Column:
    w = F.col("w") if w is None else w
    return plain_ratio(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))


def review_logistics(rows: DataFrame) -> DataFrame:
    """Low against high scores: mean delivery days, share delayed, mean delay of the delayed."""
    late = F.when(F.col("is_delayed") == 1, F.col("delay_days"))
    return (
        rows.filter(F.col("score_group").isin(LOW, HIGH))
        .groupBy("score_group")
        .agg(
            _mean(F.col("delivery_days")).alias("avg_delivery_days"),
            _mean(F.col("is_delayed")).alias("delay_rate"),
            _mean(late).alias("avg_delay_when_delayed"),
        )
    )


def low_rate(rows: DataFrame, by: str) -> DataFrame:
    low = F.when(F.col("score_group") == LOW, F.col("w")).otherwise(0)
    return (
        rows.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(plain_ratio(F.sum(low), F.sum("w")).alias("low_rate"), F.sum("w").alias("reviews"))
        .orderBy(F.desc("low_rate"), by)
    )


def review_state_rate(rows: DataFrame, customers: DataFrame) -> DataFrame:
    people = customers.select("customer_id", "customer_state")
    return low_rate(rows.join(people, "customer_id", "left"), "customer_state")


def review_amount(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("score_group").isin(LOW, HIGH))
        .groupBy("score_group")
        .agg(plain_ratio(F.sum("price_sum").cast(_SUM), F.sum("price_n")).alias("avg_price"))
    )


def review_seller_top(rows: DataFrame, top: int = 10) -> DataFrame:
    """Share of the low-scored lines that the worst sellers account for; needs lines folded by seller."""
    low = rows.filter(F.col("score_group") == LOW)
    total = low.agg(F.sum("w")).scalar()
    worst = (
        low.filter(F.col("seller_id").isNotNull())
        .groupBy("seller_id").agg(F.sum("w").alias("n"))
        .orderBy(F.desc("n"), "seller_id").limit(top)
    )
    return worst.agg(F.sum("n").alias("top_low"), F.count(F.lit(1)).alias("sellers")).select(
        "sellers", "top_low", total.alias("total_low"), plain_ratio(F.col("top_low"), total).alias("share")
    )


def review_chi2(rows: DataFrame, top: int = 20) -> DataFrame:
    """Independence of category and low score over the most reviewed categories.

    The table has at most ``top`` rows; a correction for one degree of freedom applies to two of them. Where
    all scores are low, or none, the table has one column: statistic 0, no degrees of freedom, p 1.
    """
    low = F.when(F.col("score_group") == LOW, F.col("w")).otherwise(0)
    table = (
        rows.filter(F.col("product_category_name").isNotNull())
        .groupBy("product_category_name")
        .agg(F.sum(low).alias("lows"), F.sum("w").alias("n"))
        .orderBy(F.desc("n"), "product_category_name").limit(top)
    )
    cells = table.select(
        "product_category_name", F.inline(
            F.array(
                F.struct(F.lit(1).alias("is_low"), F.col("lows").alias("seen"), F.col("n").alias("row_n")),
                F.struct(F.lit(0).alias("is_low"), (F.col("n") - F.col("lows")).alias("seen"), F.col("n").alias("row_n")),
            )
        ),
    )
    column = Window.partitionBy("is_low")
    whole = Window.partitionBy(F.lit(1))
    expected = F.col("row_n") * F.sum("seen").over(column) / F.sum("seen").over(whole)
    parts = cells.select("product_category_name", "is_low", "seen", expected.cast("double").alias("expected"))
    parts = parts.filter(F.col("expected") > 0)
    gap = F.abs(F.col("seen") - F.col("expected"))
    dof = (F.count_distinct("product_category_name") - 1) * (F.count_distinct("is_low") - 1)
    plain = F.sum(gap * gap / F.col("expected"))
    less = F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))
    corrected = F.sum(less * less / F.col("expected"))
    tail = chi2_tail(F.col("chi2"), F.col("dof").cast("double"))
    found = parts.agg(F.when(dof == 1, corrected).otherwise(plain).alias("chi2"), dof.alias("dof"))
    return found.select("chi2", "dof", F.when(F.col("dof") == 0, 1.0).otherwise(tail).alias("p_value"))


def review_mwu(rows: DataFrame) -> DataFrame:
    """Mann-Whitney U of delivery days, low above high, from the histogram of whole days.

    Mid-ranks follow from running counts over the different day values; no rows are ranked. The p-value is exact where
    a side has at most eight values and none are tied; z stays the normal deviate.
    """
    n = lambda g: F.sum(F.when(F.col("score_group") == g, F.col("w")).otherwise(0))
    hist = (
        rows.filter(F.col("delivery_days").isNotNull() & F.col("score_group").isin(LOW, HIGH))
        .groupBy("delivery_days").agg(n(LOW).alias("a"), n(HIGH).alias("b"))
    )
    upto = Window.orderBy("delivery_days").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("a") + F.col("b")
    ranked = hist.select(
        F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), t.cast("double").alias("t"),
        (F.coalesce(F.sum(t).over(upto), F.lit(0)) + (t + 1) / 2.0).cast("double").alias("mid_rank"),
    )
    one = ranked.agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("mid_rank")).alias("r1"),
        F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"),
    ).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    n1, n2 = F.col("n1"), F.col("n2")
    all_n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12.0 * ((all_n + 1) - F.col("ties") / F.nullif(all_n * (all_n - 1), F.lit(0.0))))
    z = (u - n1 * n2 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return one.select(
        n1.cast("bigint").alias("n_low"), n2.cast("bigint").alias("n_high"), u.alias("u"), z.alias("z"),
        rank_sum_tail(u, n1, n2, F.col("ties"), z).alias("p_value"),
    )


def review_score_dist(reviews: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows per score, over the folded base when given."""
    source = reviews.withColumn("w", F.lit(1)) if rows is None else rows
    return (
        source.filter(F.col("review_score").isNotNull())
        .groupBy("review_score").agg(F.sum("w").alias("reviews")).orderBy("review_score")
    )


def review_heatmap(rows: DataFrame) -> DataFrame:
    """Means of days, delay rate and price for low and high scores, plain and scaled per column."""
    means = (
        rows.filter(F.col("score_group").isin(LOW, HIGH))
        .groupBy("score_group")
        .agg(
            _mean(F.col("delivery_days")).alias("delivery_days"),
            _mean(F.col("is_delayed")).alias("delay_rate"),
            plain_ratio(F.sum("price_sum").cast(_SUM), F.sum("price_n")).alias("price"),
        )
    )
    whole = Window.partitionBy(F.lit(1))

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(whole), F.max(c).over(whole)
        return ((F.col(c) - lo) / (hi - lo + 1e-8)).alias(f"{c}_scaled")

    return means.select("*", *[scaled(c) for c in ("delivery_days", "delay_rate", "price")])
