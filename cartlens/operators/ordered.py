"""Global order without a one-task window: ranks, running totals, exact quantiles, equal-width bins.

A window without PARTITION BY pulls every row into one task. Here the rows are range-partitioned
and sorted, each row is stamped with its partition and its place in it, and the places are turned
into global ranks by adding the sizes of the partitions before. Only one small row per partition
(and per group, where groups come from a fixed short list) takes part in the last step.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cartlens.operators import selection
from cartlens.session import written

_PLACE_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits
_PLACE_MASK = (1 << _PLACE_BITS) - 1


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows in global order over (_part, _place), written once since range bounds are sampled.

    End ``order`` with a unique column: then no run of equal values is tied to one partition.
    """
    cols = [_col(c) for c in order]
    stamped = (
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_stamp", F.monotonically_increasing_id())
    )
    fixed = written(stamped, "ordered")
    return fixed.select(
        *df.columns,
        F.shiftright("_stamp", _PLACE_BITS).alias("_part"),
        F.col("_stamp").bitwiseAND(F.lit(_PLACE_MASK)).alias("_place"),
    )


def _before(within: Sequence[str]) -> Window:
    rows = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    return rows.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def global_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Adds the row number (from 1) in ``order`` and the number of rows, over all or within groups.

    ``within`` takes columns with a short fixed list of values (measures, segments, classes): the
    offsets hold at most partitions + groups rows, since a group covers neighbouring partitions.
    """
    rows = range_sorted(df, [*within, *order])
    counts = rows.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    offsets = counts.select(
        F.col("_part").alias("_o_part"),
        *[F.col(c).alias(f"_o_{c}") for c in within],
        (F.coalesce(F.sum("_n").over(_before(within)), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(whole).alias(size),
    )
    on = F.col("_part") == F.col("_o_part")
    for c in within:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return rows.join(F.broadcast(offsets), on).select(
        *df.columns, (F.col("_place") + F.col("_shift")).alias(rank), F.col(size)
    )


def running_totals(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Adds inclusive running sums in global order: ``{new column: summed column}``."""
    rows = range_sorted(df, order)
    per_part = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    offsets = per_part.select(
        F.col("_part").alias("_o_part"),
        *[F.coalesce(F.sum(f"_t_{out}").over(_before(())), F.lit(0)).alias(f"_b_{out}") for out in sums],
    )
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_l_{out}") for out, c in sums.items()])
    return local.join(F.broadcast(offsets), F.col("_part") == F.col("_o_part")).select(
        *df.columns, *[(F.col(f"_l_{out}") + F.col(f"_b_{out}")).alias(out) for out in sums]
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], within: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles per group, selected without ranking rows or holding a group in memory.

    ``probs`` names the output columns. Nulls take no part; a group without values gives no row. ``within`` takes
    columns with a short fixed list of values. The frame is read several times: hand in a stored one.
    """
    data = df.filter(F.col(value).isNotNull()).select(*within, F.col(value).cast("double").alias("_v"))
    sizes = selection.group_sizes(data, within)
    picks = {g: {name: selection.quantile_places(n, p) for name, p in probs.items()} for g, n in sizes.items()}
    wanted = {g: {r for low, high, _ in p.values() for r in (low, high)} for g, p in picks.items()}
    keys = selection.rows_at(data, [F.col("_v")], wanted, sizes, within)
    rows = []
    for g, named in picks.items():
        ends = [(keys[g, low][0], keys[g, high][0], part) for low, high, part in named.values()]
        rows.append((*g, *[lo + part * (hi - lo) if part else lo for lo, hi, part in ends]))
    schema = StructType([*data.select(*within).schema, *[StructField(name, DoubleType()) for name in probs]])
    return df.sparkSession.createDataFrame(rows, schema)


def equal_width_bins(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum; the last bin is closed, empty ones stay."""
    data = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    limits = data.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("s")).scalar()
    counted = (
        data.select(bin_number(F.col("_v"), limits["lo"], limits["hi"], bins).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    edges = data.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).filter(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi"
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lower_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def bin_number(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = F.nullif(hi - lo, F.lit(0.0))
    raw = F.floor((value - lo) / width * bins)
    return F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")
