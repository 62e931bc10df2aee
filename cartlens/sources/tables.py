"""Reading and writing tables, and the session catalog."""

from __future__ import annotations

from functools import reduce
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from cartlens.operators.clean import TIME_COLUMNS, parse_times
from cartlens.schema import KEYS, SCHEMAS


def read_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    """UTF-8 CSV with a header. Columns are taken by name, not by place; unreadable values become null.

    A byte-order mark may stand before the first header, so that name is cleaned before the lookup.
    ``multiline`` allows line breaks inside quotes at the price of reading each file in one task; split
    such a table into many files.
    """
    header = spark.read.csv(path, header=True, multiLine=multiline, escape='"', encoding="UTF-8", inferSchema=False)
    plain = {c.lstrip("﻿").strip('"'): c for c in header.columns}
    columns = []
    for field in schema:
        if field.name not in plain:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            source = plain[field.name].replace("`", "``")
            columns.append(F.col(f"`{source}`").try_cast(field.dataType).alias(field.name))
    return header.select(*columns)


def read_csv_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """The known tables among ``{table: path}``; a missing file is left out."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = read_csv(spark, path, SCHEMAS[name], multiline=name == "order_reviews")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def read_parquet(spark: SparkSession, path: str, times: tuple[str, ...] = TIME_COLUMNS) -> DataFrame:
    """An intermediate table with its time columns as timestamps whatever type they were stored in."""
    return parse_times(spark.read.parquet(path), times)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def query(spark: SparkSession, sql: str, params: Mapping | None = None) -> DataFrame:
    return spark.sql(sql, args=dict(params)) if params else spark.sql(sql)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def load_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def list_tables(spark: SparkSession) -> DataFrame:
    names = sorted(t.name for t in spark.catalog.listTables())
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def table_info(df: DataFrame, name: str) -> DataFrame:
    """One row per column with the table's row and column counts."""
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(k).alias("column_type"))
            for i, (c, k) in enumerate(df.dtypes)
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"), F.inline(columns)
    )


def save_table(df: DataFrame, name: str, if_exists: str = "replace", path: str | None = None) -> None:
    modes = {"replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ValueError(f"if_exists must be one of {sorted(modes)}")
    writer = df.write.mode(modes[if_exists]).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def key_check(df: DataFrame, name: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Rows, rows with a missing key part, and key values that occur more than once."""
    keys = KEYS[name] if keys is None else keys
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.count_if(~missing & (F.col("_n") > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(~missing, F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"),
    ).select(F.lit(name).alias("table_name"), "*")
