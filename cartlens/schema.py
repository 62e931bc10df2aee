"""Declared column types and keys of the nine tables. Nothing is inferred from files."""

from pyspark.sql import types as T

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampNTZType()
_PRICE, _SIZE, _DEGREE = T.DecimalType(10, 2), T.DecimalType(8, 2), T.DecimalType(18, 14)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _table(
        ("customer_id", _S), ("customer_unique_id", _S), ("customer_zip_code_prefix", _I),
        ("customer_city", _S), ("customer_state", _S),
    ),
    "orders": _table(
        ("order_id", _S), ("customer_id", _S), ("order_status", _S),
        ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
        ("order_delivered_carrier_date", _TS), ("order_delivered_customer_date", _TS),
        ("order_estimated_delivery_date", _TS),
    ),
    "order_items": _table(
        ("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
        ("shipping_limit_date", _TS), ("price", _PRICE), ("freight_value", _PRICE),
    ),
    "order_payments": _table(
        ("order_id", _S), ("payment_sequential", _I), ("payment_type", _S),
        ("payment_installments", _I), ("payment_value", _PRICE),
    ),
    "order_reviews": _table(
        ("review_id", _S), ("order_id", _S), ("review_score", _I), ("review_comment_title", _S),
        ("review_comment_message", _S), ("review_creation_date", _TS), ("review_answer_timestamp", _TS),
    ),
    "products": _table(
        ("product_id", _S), ("product_category_name", _S), ("product_name_lenght", _I),
        ("product_description_lenght", _I), ("product_photos_qty", _I), ("product_weight_g", _I),
        ("product_length_cm", _SIZE), ("product_height_cm", _SIZE), ("product_width_cm", _SIZE),
    ),
    "sellers": _table(
        ("seller_id", _S), ("seller_zip_code_prefix", _I), ("seller_city", _S),
        ("seller_state", _S), ("seller_name", _S),
    ),
    "geolocation": _table(
        ("geolocation_zip_code_prefix", _I), ("geolocation_lat", _DEGREE), ("geolocation_lng", _DEGREE),
        ("geolocation_city", _S), ("geolocation_state", _S),
    ),
    "category_translation": _table(
        ("product_category_name", _S), ("product_category_name_english", _S),
    ),
}

# The columns that must be present and unique together; empty where duplicates are allowed.
KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id",),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "geolocation": (),
    "category_translation": ("product_category_name",),
}
