"""Conforming the nine tables: codes to labels, generated names, texts and postal codes."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.fixed_values import (
    CATEGORY_LABELS, CITY_LABELS, NEGATIVE_COMMENTS, NEUTRAL_COMMENTS, OTHER_CATEGORY, PAYMENT_LABELS,
    POSITIVE_COMMENTS, PROVINCE_CAPITALS, SHOP_GOODS, SHOP_KINDS, SHOP_REGIONS, STATE_LABELS, UNKNOWN_PLACE,
)
from cartlens.functions.scalars import hash_below, lookup, not_blank, pick


def recode_state(code: Column) -> Column:
    return lookup(STATE_LABELS, code, F.lit(UNKNOWN_PLACE))


def recode_category(code: Column) -> Column:
    """Unknown codes become the rest label; a missing code stays missing."""
    return F.when(code.isNotNull(), lookup(CATEGORY_LABELS, code, F.lit(OTHER_CATEGORY)))


def recode_payment(code: Column) -> Column:
    """Unknown codes stay as they are."""
    return lookup(PAYMENT_LABELS, code, code)


def recode_city(city: Column, state: Column) -> Column:
    """The city's own label, else the capital of its province, else unknown."""
    own = lookup(CITY_LABELS, F.lower(F.trim(city)))
    capital = lookup(PROVINCE_CAPITALS, recode_state(state))
    return F.coalesce(own, capital, F.lit(UNKNOWN_PLACE))


def recode_dim(df: DataFrame, column: str, mapping: DataFrame, default: Column | None = None) -> DataFrame:
    """Recode by a two-column (code, label) table of any size; the planner picks the join by its true size."""
    code, label = mapping.columns
    pairs = mapping.select(F.col(code).alias("_code"), F.col(label).alias("_label"))
    hit = df.join(pairs, F.col(column) == F.col("_code"), "left")
    value = F.col("_label") if default is None else F.coalesce("_label", default)
    return hit.withColumn(column, value).select(*df.columns)


def shop_name(seller_id: Column) -> Column:
    """Three words picked by the md5 of the id as one 128-bit number h: h mod 8, h div 8 mod 16, h div 128 mod 6.

    The number is split in two 64-bit halves. The first two remainders lie in the low half. For the
    third, h div 128 = high * 2^57 + low div 128, and 2^57 leaves 2 when divided by 6.
    """
    digest = F.md5(seller_id.cast("string"))
    half = lambda start: F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")
    high, low = half(1), half(17)
    whole = lambda n: F.lit(n).cast("decimal(20,0)")
    region = (low % whole(8)).cast("int")
    goods = (F.floor(low / whole(8)) % whole(16)).cast("int")
    kind = ((whole(2) * (high % whole(6)) + F.floor(low / whole(128)) % whole(6)) % whole(6)).cast("int")
    return F.concat(pick(SHOP_REGIONS, region), pick(SHOP_GOODS, goods), pick(SHOP_KINDS, kind))


def comment_for(score: Column, message: Column, key: Column, seed: int = 42) -> Column:
    """A stock text by score for a non-blank comment, empty text otherwise.

    The pick is a hash of the review key, so it does not depend on row order or partitioning.
    """
    choose = lambda texts: pick(texts, hash_below(key, len(texts), f"{seed}:"))
    by_score = (
        F.when(score >= 4, choose(POSITIVE_COMMENTS)).when(score == 3, choose(NEUTRAL_COMMENTS))
        .otherwise(choose(NEGATIVE_COMMENTS))
    )
    return F.when(F.coalesce(not_blank(message), F.lit(False)), by_score).otherwise(F.lit(""))


def postal_code(key: Column, seed: int = 42) -> Column:
    """A six-digit code fixed by the row key."""
    return F.lit(100000) + hash_below(key, 900000, f"zip{seed}:")


def conform_customers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "customer_city": recode_city(F.col("customer_city"), F.col("customer_state")),
            "customer_state": recode_state(F.col("customer_state")),
            "customer_zip_code_prefix": postal_code(F.col("customer_id")).cast("int"),
        }
    )


def conform_products(df: DataFrame) -> DataFrame:
    return df.withColumn("product_category_name", recode_category(F.col("product_category_name")))


def conform_payments(df: DataFrame) -> DataFrame:
    return df.withColumn("payment_type", recode_payment(F.col("payment_type")))


def conform_reviews(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "review_comment_title": F.lit(""),
            "review_comment_message": comment_for(
                F.col("review_score"), F.col("review_comment_message"), F.col("review_id")
            ),
        }
    )


def conform_geolocation(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "geolocation_city": recode_city(F.col("geolocation_city"), F.col("geolocation_state")),
            "geolocation_state": recode_state(F.col("geolocation_state")),
        }
    )


def conform_sellers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "seller_city": recode_city(F.col("seller_city"), F.col("seller_state")),
            "seller_state": recode_state(F.col("seller_state")),
            "seller_zip_code_prefix": postal_code(F.col("seller_id")).cast("int"),
            "seller_name": shop_name(F.col("seller_id")),
        }
    )


def conform_translation(df: DataFrame) -> DataFrame:
    label = recode_category(F.col("product_category_name"))
    return df.withColumns({"product_category_name": label, "product_category_name_english": label})


def _unchanged(df: DataFrame) -> DataFrame:
    return df


CONFORM: dict[str, Callable[[DataFrame], DataFrame]] = {
    "customers": conform_customers,
    "products": conform_products,
    "orders": _unchanged,
    "order_items": _unchanged,
    "order_payments": conform_payments,
    "order_reviews": conform_reviews,
    "sellers": conform_sellers,
    "geolocation": conform_geolocation,
    "category_translation": conform_translation,
}


def conform_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that are present, each in its conformed form."""
    return {name: CONFORM[name](df) for name, df in tables.items() if name in CONFORM}
