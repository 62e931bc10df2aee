"""Reads the driver's star-schema tables as the nine commerce tables.

Only integer arithmetic and constants are used, so another engine gets the same rows from
``oracle.MODEL_TABLES``. Each property is a lazy DataFrame; a query pays for the columns it reads.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.functions.scalars import MONEY

CUTOFF = "2001-08-02"
STATUS = {"F": "delivered", "O": "shipped", "P": "processing"}
PAYMENT_CODES = {"A": "credit_card", "N": "boleto", "R": "voucher"}
MARGINS = {"ECONOMY": 0.12, "STANDARD": 0.15, "PROMO": 0.50, "LARGE": 0.40}


def _add(ts: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return ts + F.make_dt_interval(as_int(days), as_int(hours), F.lit(0), F.lit(0))


class StarSource:
    def __init__(self, spark: SparkSession, folder: str, category: str = "p_type"):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.category = category
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def _orders(self, raw: DataFrame) -> DataFrame:
        k = F.col("o_orderkey")
        bought = _add(F.col("o_orderdate"), hours=k * 11 % 24)
        status = F.col("o_orderstatus")
        label = F.when(status == "F", STATUS["F"]).when(status == "O", STATUS["O"]).when(status == "P", STATUS["P"])
        return raw.select(
            k.alias("order_id"),
            k.alias("customer_id"),
            label.alias("order_status"),
            bought.alias("order_purchase_timestamp"),
            _add(bought, hours=1).alias("order_approved_at"),
            _add(bought, days=1).alias("order_delivered_carrier_date"),
            F.when(k % 97 != 0, _add(bought, days=k * 37 % 30 + 1, hours=k * 5 % 24)).alias(
                "order_delivered_customer_date"
            ),
            _add(F.col("o_orderdate"), days=k * 53 % 20 + 10).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders(self.raw("orders"))

    @cached_property
    def delivered(self) -> DataFrame:
        """Delivered orders only, with the predicate on the stored column so that it reaches the scan."""
        return self._orders(self.raw("orders").filter(F.col("o_orderstatus") == "F"))

    @cached_property
    def customer_keys(self) -> DataFrame:
        """The two key columns of ``customers``, without the joins the address columns need."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("customer_id"), F.col("o_custkey").alias("customer_unique_id")
        )

    @cached_property
    def customers(self) -> DataFrame:
        people = self.raw("customer").join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        return (
            self.raw("orders")
            .join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(
                F.col("o_orderkey").alias("customer_id"),
                F.col("o_custkey").alias("customer_unique_id"),
                (F.lit(10000) + F.col("c_nationkey")).cast("int").alias("customer_zip_code_prefix"),
                F.col("c_mktsegment").alias("customer_city"),
                F.col("n_name").alias("customer_state"),
            )
        )

    @cached_property
    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast(MONEY)
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            price.alias("price"),
            (price * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY).alias("freight_value"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col(self.category).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.col("p_size").alias("product_weight_g"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("s_suppkey").alias("seller_id"),
                (F.lit(20000) + F.col("s_nationkey")).cast("int").alias("seller_zip_code_prefix"),
                F.col("s_name").alias("seller_city"),
                F.col("n_name").alias("seller_state"),
            )
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        """One payment per (order, return flag). The window runs over at most a few rows per order."""
        per_type = (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_returnflag")
            .agg(
                F.count(F.lit(1)).cast("int").alias("payment_installments"),
                F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("payment_value"),
            )
        )
        order = Window.partitionBy("l_orderkey").orderBy("l_returnflag")
        return per_type.select(
            F.col("l_orderkey").alias("order_id"),
            F.row_number().over(order).alias("payment_sequential"),
            F.col("l_returnflag").alias("payment_type"),
            "payment_installments",
            "payment_value",
        )

    def _reviewed(self, *columns: str) -> DataFrame:
        """Orders with their text: every tenth order goes without a review, unless a text hangs on its key."""
        texts = self.raw("documents").select("doc_id", *columns)
        rows = self.raw("orders").join(texts, F.col("o_orderkey") == F.col("doc_id"), "left")
        return rows.filter((F.col("o_orderkey") % 10 != 0) | F.col("doc_id").isNotNull())

    def _review_columns(self, message: Column) -> list[Column]:
        k = F.col("o_orderkey")
        return [
            k.alias("review_id"),
            k.alias("order_id"),
            (F.lit(1) + k * 7 % 5).cast("int").alias("review_score"),
            message.alias("review_comment_message"),
            _add(F.col("o_orderdate"), days=40).alias("review_creation_date"),
        ]

    @cached_property
    def review_scores(self) -> DataFrame:
        """Reviews for operators that never read the text."""
        return self._reviewed().select(*self._review_columns(F.lit(None).cast("string")))

    @cached_property
    def order_reviews(self) -> DataFrame:
        return self._reviewed("text").select(*self._review_columns(F.col("text")))

    @cached_property
    def category_translation(self) -> DataFrame:
        name = F.col(self.category)
        return self.raw("part").select(
            name.alias("product_category_name"), F.lower(name).alias("product_category_name_english")
        ).distinct()

    @cached_property
    def geolocation(self) -> DataFrame:
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                (F.lit(10000) + F.col("c_nationkey")).cast("int").alias("geolocation_zip_code_prefix"),
                (F.col("c_custkey") % 180 - 90).cast("decimal(18,14)").alias("geolocation_lat"),
                (F.col("c_custkey") % 360 - 180).cast("decimal(18,14)").alias("geolocation_lng"),
                F.col("c_mktsegment").alias("geolocation_city"),
                F.col("n_name").alias("geolocation_state"),
            )
        )

    TABLES = (
        "orders", "order_items", "order_payments", "order_reviews", "products", "customers",
        "sellers", "geolocation", "category_translation",
    )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
