"""Customer features, one row per ``customer_unique_id``.

Every set is built from per-order aggregates: items, payments and reviews shrink to one row per
order first, the orders are joined to them on the order key they are then already partitioned by,
and one more aggregation brings them to the person. The wide table takes all order-level sets in
one pass, so it shuffles the orders to the person once and not six times. A person or an order
with a large share of all rows meets only partial aggregation on its way.

The ``*_fanout`` forms give the numbers of an aggregation over orders x items x payments x reviews.
They multiply by the row counts of the other sides instead of building the product.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.config import SQL, check_dialect
from cartlens.functions.scalars import MONEY, day_difference, exact_ratio, flag, plain_ratio

PERSON = "customer_unique_id"
_DAYS = "decimal(18,2)"


# --- one row per order -----------------------------------------------------------------------

def order_amounts(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.count("product_id").alias("item_count"),
        F.sum("price").alias("order_spend"),
        F.sum("freight_value").alias("order_freight"),
    )


def order_payment_stats(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_rows"),
        F.count("payment_installments").alias("installment_count"),
        F.sum("payment_installments").alias("installment_sum"),
        F.max("payment_installments").alias("installment_max"),
    )


def order_review_stats(reviews: DataFrame, low_score: int = 2) -> DataFrame:
    """Score measures count reviews with a score; ``has_text`` sees non-empty, ``has_message`` non-null text."""
    scored = F.col("review_score").isNotNull()
    text = F.col("review_comment_message")
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_rows"),
        F.count("review_score").alias("score_count"),
        F.sum("review_score").alias("score_sum"),
        F.min("review_score").alias("score_min"),
        F.count_if(F.col("review_score") <= low_score).alias("low_count"),
        F.max(F.when(scored, flag(text != ""))).alias("has_text"),
        F.max(flag(text.isNotNull())).alias("has_message"),
    )


def _on_orders(orders: DataFrame, *sides: DataFrame) -> DataFrame:
    return reduce(lambda left, side: left.join(side, "order_id", "left"), sides, orders)


# --- aggregates per person -------------------------------------------------------------------

def _transaction(dialect: str, weight: Column | None = None) -> dict[str, Column]:
    w = F.lit(1) if weight is None else weight
    money = lambda c: F.sum((F.coalesce(F.col(c), F.lit(0).cast(MONEY)) * w.cast("decimal(10,0)")).cast("decimal(28,2)"))
    spend, freight, n = money("order_spend"), money("order_freight"), F.count(F.lit(1))
    lines = F.sum(F.coalesce(F.col("item_count"), F.lit(0)) * w)
    total = spend + freight
    ratio = (lambda a, b, d: exact_ratio(a, b, d)) if dialect == SQL else (lambda a, b, d: plain_ratio(a, b))
    return {
        "total_orders": n,
        "total_spend": total,
        "total_freight": freight,
        "avg_items_per_order": ratio(lines, n, 2),
        "avg_order_value": ratio(total, n, 2),
    }


def _time(cutoff: str, dialect: str) -> dict[str, Column]:
    end = F.lit(cutoff).cast("timestamp_ntz")
    first, last = F.min("order_purchase_timestamp"), F.max("order_purchase_timestamp")
    n = F.count(F.lit(1))
    tenure = day_difference(end, first, dialect)
    span = day_difference(last, first, dialect)
    if dialect == SQL:
        # n / max(tenure/30, 1) = 30n / max(tenure, 30), which keeps the division exact
        frequency = exact_ratio(n * 30, F.greatest(tenure, F.lit(30)), 4)
        gap = exact_ratio(span, n - 1, 1)
    else:
        frequency = n.cast("double") / F.greatest(tenure.cast("double") / 30.0, F.lit(1.0))
        gap = plain_ratio(span, n - 1)
    return {
        "first_purchase_date": first,
        "last_purchase_date": last,
        "customer_tenure_days": tenure,
        "recency_days": day_difference(end, last, dialect),
        "purchase_frequency": frequency,
        "avg_purchase_interval": F.when(n > 1, gap),
    }


def _delivery(dialect: str, severe_days: int) -> dict[str, Column]:
    days, delay, n = F.col("delivery_days"), F.col("delivery_delay_days"), F.count(F.lit(1))
    late = F.count_if(delay > 0)
    severe = F.max(flag(delay > severe_days))
    if dialect == SQL:
        means = exact_ratio(F.sum(days), F.count(days), 1), exact_ratio(F.sum(delay), F.count(delay), 1)
        share = exact_ratio(late, n, 4)
    else:
        means = F.avg(days), F.avg(delay)
        share = plain_ratio(late, n)
        severe = severe == 1
    return {
        "avg_delivery_days": means[0],
        "avg_delivery_delay": means[1],
        "max_delivery_delay": F.max(delay),
        "delayed_order_ratio": share,
        "has_severe_delay": severe,
    }


def _review() -> dict[str, Column]:
    low = F.sum("low_count")
    return {
        "avg_review_score": exact_ratio(F.sum("score_sum"), F.sum("score_count"), 2),
        "min_review_score": F.min("score_min"),
        "low_score_count": low,
        "low_score_ratio": exact_ratio(low, F.sum("score_count"), 4),
        "has_review_comment": F.max("has_text"),
    }


def _payment_numbers() -> dict[str, Column]:
    return {
        "avg_installments": exact_ratio(F.sum("installment_sum"), F.sum("installment_count"), 2),
        "max_installments": F.max("installment_max"),
    }


def _per_person(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.groupBy(PERSON).agg(*[c.alias(name) for name, c in columns.items()])


# --- the six sets ----------------------------------------------------------------------------

def feat_transaction(cleaned: DataFrame, items: DataFrame, dialect: str = SQL) -> DataFrame:
    check_dialect(dialect)
    return _per_person(_on_orders(cleaned, order_amounts(items)), _transaction(dialect))


def feat_time(cleaned: DataFrame, cutoff: str, dialect: str = SQL) -> DataFrame:
    return _per_person(cleaned, _time(cutoff, check_dialect(dialect)))


def feat_delivery(cleaned: DataFrame, dialect: str = SQL, severe_days: int = 7) -> DataFrame:
    return _per_person(cleaned, _delivery(check_dialect(dialect), severe_days))


def order_categories(items: DataFrame, products: DataFrame) -> DataFrame:
    """(order, category) totals of the lines with a known category."""
    known = products.select("product_id", "product_category_name").filter(F.col("product_category_name").isNotNull())
    return (
        items.join(known, "product_id")
        .groupBy("order_id", "product_category_name")
        .agg(F.count(F.lit(1)).alias("cat_count"), F.sum("price").alias("cat_spend"))
    )


def feat_category(cleaned: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Main category (most lines, then spend, then label), number of categories, largest spend share.

    Lines get their person first: other orders' lines never meet the products, and one aggregation does what takes two
    where lines are folded per order and category.
    """
    known = products.select("product_id", "product_category_name").filter(F.col("product_category_name").isNotNull())
    per_category = (
        cleaned.select("order_id", PERSON)
        .join(items.select("order_id", "product_id", "price"), "order_id")
        .join(known, "product_id")
        .groupBy(PERSON, "product_category_name")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("decimal(28,2)").alias("spend"))
    )
    label = F.col("product_category_name")
    return per_category.groupBy(PERSON).agg(
        F.count(F.lit(1)).alias("category_diversity"),
        F.min_by(label, F.struct(-F.col("n"), -F.col("spend"), label)).alias("main_category"),
        F.round(F.max("spend") / F.nullif(F.sum("spend").cast("decimal(18,2)"), F.lit(0).cast(MONEY)), 4)
        .cast("double").alias("top_category_spend_ratio"),
    )


def main_payment_type(cleaned: DataFrame, payments: DataFrame) -> DataFrame:
    """Most used payment type per person; the smaller label on equal counts."""
    uses = (
        cleaned.select("order_id", PERSON)
        .join(payments.groupBy("order_id", "payment_type").agg(F.count(F.lit(1)).alias("uses")), "order_id")
        .groupBy(PERSON, "payment_type").agg(F.sum("uses").alias("uses"))
    )
    kind = F.col("payment_type")
    return uses.groupBy(PERSON).agg(F.min_by(kind, F.struct(-F.col("uses"), kind)).alias("main_payment_type"))


def feat_payment(cleaned: DataFrame, payments: DataFrame) -> DataFrame:
    """One aggregation to (person, type) carries both the counts and the installment sums.

    Payments of other orders leave first; what remains lies by order and is folded without another shuffle.
    """
    paid = payments.join(cleaned.select("order_id"), "order_id", "left_semi")
    per_type = paid.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("uses"),
        F.count("payment_installments").alias("installment_count"),
        F.sum("payment_installments").alias("installment_sum"),
        F.max("payment_installments").alias("installment_max"),
    )
    kind = F.col("payment_type")
    return (
        cleaned.select("order_id", PERSON)
        .join(per_type, "order_id")
        .groupBy(PERSON, "payment_type")
        .agg(
            F.sum("uses").alias("uses"),
            F.sum("installment_count").alias("installment_count"),
            F.sum("installment_sum").alias("installment_sum"),
            F.max("installment_max").alias("installment_max"),
        )
        .groupBy(PERSON)
        .agg(
            F.min_by(kind, F.struct(-F.col("uses"), kind)).alias("main_payment_type"),
            *[c.alias(n) for n, c in _payment_numbers().items()],
        )
    )


def feat_review(cleaned: DataFrame, reviews: DataFrame, low_score: int = 2) -> DataFrame:
    scored = reviews.filter(F.col("review_score").isNotNull())
    rows = cleaned.select("order_id", PERSON).join(order_review_stats(scored, low_score), "order_id")
    return _per_person(rows, _review())


# --- the fan-out forms -----------------------------------------------------------------------

def _times(*columns: str) -> Column:
    """Rows the other sides of a left join contribute: at least one each."""
    factors = [F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(1)) for c in columns]
    return reduce(lambda a, b: a * b, factors)


def _wide_orders(
    cleaned: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame, low_score: int = 2
) -> DataFrame:
    return _on_orders(
        cleaned, order_amounts(items), order_payment_stats(payments), order_review_stats(reviews, low_score)
    )


def feat_transaction_fanout(wide: DataFrame) -> DataFrame:
    return _per_person(wide, _transaction("frame", _times("payment_rows", "review_rows")))


def feat_review_fanout(wide: DataFrame) -> DataFrame:
    w = _times("item_rows", "payment_rows")
    low, n = F.sum(F.coalesce(F.col("low_count"), F.lit(0)) * w), F.sum(F.col("score_count") * w)
    return _per_person(
        wide,
        {
            "avg_review_score": plain_ratio(F.sum(F.col("score_sum") * w), n),
            "min_review_score": F.min("score_min"),
            "low_score_count": low,
            "low_score_ratio": plain_ratio(low, n),
            "has_review_comment": F.coalesce(F.max("has_message"), F.lit(0)) == 1,
        },
    )


def _sizes(wide: DataFrame, *counts: str) -> DataFrame:
    return wide.select("order_id", PERSON, _times(*counts).alias("w"))


def feat_payment_fanout(wide: DataFrame, payments: DataFrame) -> DataFrame:
    """Persons without payments keep a row of nulls."""
    per_type = payments.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("uses"),
        F.count("payment_installments").alias("n"),
        F.sum("payment_installments").alias("s"),
        F.max("payment_installments").alias("m"),
    )
    kind, w = F.col("payment_type"), F.col("w")
    rows = (
        _sizes(wide, "item_rows", "review_rows")
        .join(per_type, "order_id", "left")
        .groupBy(PERSON, "payment_type")
        .agg(
            F.sum(F.col("uses") * w).alias("uses"),
            F.sum(F.col("n") * w).alias("n"),
            F.sum(F.col("s") * w).alias("s"),
            F.max("m").alias("m"),
        )
    )
    return rows.groupBy(PERSON).agg(
        F.min_by(kind, F.when(kind.isNotNull(), F.struct(-F.col("uses"), kind))).alias("main_payment_type"),
        plain_ratio(F.sum("s"), F.sum("n")).alias("avg_installments"),
        F.max("m").alias("max_installments"),
    )


def _category_fanout(wide: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    w = F.col("w")
    return (
        _sizes(wide, "payment_rows", "review_rows")
        .join(order_categories(items, products), "order_id", "left")
        .groupBy(PERSON, "product_category_name")
        .agg(
            F.sum(F.col("cat_count") * w).alias("n"),
            F.sum((F.col("cat_spend") * w.cast("decimal(10,0)")).cast("decimal(28,2)")).alias("spend"),
        )
    )


def feat_category_mode(wide: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Most frequent category over the fanned-out lines; the smallest label on ties, null when none is known."""
    label = F.col("product_category_name")
    return _category_fanout(wide, items, products).groupBy(PERSON).agg(
        F.min_by(label, F.when(label.isNotNull(), F.struct(-F.col("n"), label))).alias("main_category")
    )


def feat_category_fanout(wide: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    label = F.col("product_category_name")
    return _category_fanout(wide, items, products).groupBy(PERSON).agg(
        F.count(label).alias("category_diversity"),
        F.min_by(label, F.when(label.isNotNull(), F.struct(-F.col("n"), label))).alias("main_category"),
        plain_ratio(F.max(F.when(label.isNotNull(), F.col("spend"))), F.sum(F.when(label.isNotNull(), F.col("spend"))))
        .alias("top_category_spend_ratio"),
    )


# --- the wide table --------------------------------------------------------------------------

FEATURE_ORDER = (
    "total_orders", "total_spend", "total_freight", "avg_items_per_order", "avg_order_value",
    "first_purchase_date", "last_purchase_date", "customer_tenure_days", "recency_days",
    "purchase_frequency", "avg_purchase_interval",
    "avg_delivery_days", "avg_delivery_delay", "max_delivery_delay", "delayed_order_ratio", "has_severe_delay",
    "category_diversity", "main_category", "top_category_spend_ratio",
    "main_payment_type", "avg_installments", "max_installments",
    "avg_review_score", "min_review_score", "low_score_count", "low_score_ratio", "has_review_comment",
)


def user_features(
    cleaned: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    cutoff: str,
    dialect: str = SQL,
    low_score: int = 2,
    severe_days: int = 7,
    columns: Sequence[str] = FEATURE_ORDER,
) -> DataFrame:
    """Key and ``columns``; the sql dialect leaves out the sets none of them is from."""
    check_dialect(dialect)
    if dialect == SQL:
        scored = reviews.filter(F.col("review_score").isNotNull())
        # other orders' lines leave before they are summed, which then needs no shuffle of its own
        sold = items.join(cleaned.select("order_id"), "order_id", "left_semi")
        rows = _on_orders(cleaned, order_amounts(sold), order_review_stats(scored, low_score))
        spine = _per_person(
            rows, {**_transaction(SQL), **_time(cutoff, SQL), **_delivery(SQL, severe_days), **_review()}
        )
        sides = [feat_category(cleaned, items, products), feat_payment(cleaned, payments)]
        sides = [side for side in sides if set(side.columns) & set(columns)]
    else:
        rows = _wide_orders(cleaned, items, payments, reviews, low_score)
        spine = _per_person(
            rows,
            {
                **_transaction("frame", _times("payment_rows", "review_rows")),
                **_time(cutoff, "frame"), **_delivery("frame", severe_days),
            },
        )
        sides = [
            feat_review_fanout(rows),
            feat_category_fanout(rows, items, products),
            feat_payment_fanout(rows, payments),
        ]
    table = reduce(lambda left, side: left.join(side, PERSON, "left"), sides, spine)
    return table.select(PERSON, *columns)


def features_summary(features: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return features.agg(
        n.alias("total_users"),
        F.count("rfm_segment").alias("rfm_labeled"),
        exact_ratio(F.sum("total_orders"), n, 2).alias("avg_orders"),
        exact_ratio(F.sum("total_spend"), n, 2).alias("avg_spend"),
        exact_ratio(F.sum("recency_days"), n, 1).alias("avg_recency"),
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, count and share, from one aggregation over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("null_count"))
                for c in df.columns
            ]
        ).alias("_cols"),
    )
    return counts.select("_n", F.inline("_cols")).select(
        "column_name", "null_count", F.round(plain_ratio(F.col("null_count"), F.col("_n")), 6).alias("null_ratio")
    )
