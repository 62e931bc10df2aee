"""Rows at given places of a sorted order, without sorting: sampled pivots, counts between them, again inside.

Each pass narrows the intervals that hold the sought places by about the number of pivots. What reaches the
driver is a few hundred pivots and counts an interval, whatever the size of the input. The frame is read once
per pass, so hand in a stored one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from math import floor
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

LEAF = 4096  # an interval of at most this many rows is sorted in one group
PIVOTS = 63
SAMPLE = 8  # sampled rows a pivot
TREE_NODES = 1024  # pivots of all intervals of a pass

Key = tuple


@dataclass(frozen=True)
class _Open:
    """Rows of a group strictly between two keys; None leaves that side open."""

    group: tuple
    low: Key | None
    high: Key | None
    before: int
    size: int


def _less(key: Key, cols: Sequence[Column]) -> Column:
    """cols < key in the order of the columns."""
    first = cols[0] < F.lit(key[0])
    if len(cols) == 1:
        return first
    return first | ((cols[0] == F.lit(key[0])) & _less(key[1:], cols[1:]))


def _same(key: Key, cols: Sequence[Column]) -> Column:
    one = F.lit(True)
    for k, c in zip(key, cols):
        one = one & (c == F.lit(k))
    return one


def above(key: Key, cols: Sequence[Column]) -> Column:
    """cols > key in the order of the columns; all of them non-null."""
    return ~_less(key, cols) & ~_same(key, cols)


def _struct(values: Iterable[Column]) -> Column:
    return F.struct(*[v.alias(f"k{j}") for j, v in enumerate(values)])


def _interval(opened: Sequence[_Open], groups: dict[str, DataType], cols: Sequence[Column], kinds: Sequence[DataType]) -> Column:
    """Number of the interval a row lies in, null for none. Like pivots, intervals are values in the plan."""
    row = _struct(cols)
    blank = F.lit(None).cast(StructType([StructField(f"k{j}", t) for j, t in enumerate(kinds)]))
    end = lambda key: blank if key is None else _struct(F.lit(v).cast(t) for v, t in zip(key, kinds))
    held = lambda o: reduce(
        Column.__and__, [o[f"g{j}"].eqNullSafe(F.col(name)) for j, name in enumerate(groups)],
        (o["low"].isNull() | (o["low"] < row)) & (o["high"].isNull() | (row < o["high"])),
    )
    every = F.array(*[F.struct(
        *[F.lit(g).cast(t).alias(f"g{j}") for j, (g, t) in enumerate(zip(o.group, groups.values()))],
        end(o.low).alias("low"), end(o.high).alias("high"), F.lit(i).alias("at"),
    ) for i, o in enumerate(opened)])
    return F.get(F.filter(every, held), F.lit(0))["at"]


def _bucket(pivots: Sequence[Sequence[Key]], at: Column, cols: Sequence[Column], kinds: Sequence[DataType]) -> Column:
    """Even numbers lie between the pivots of interval ``at``, odd ones are a pivot.

    A binary search in an array: the plan holds the pivots as values, not as a tree of comparisons for each of them.
    """
    key = StructType([StructField(f"k{j}", t) for j, t in enumerate(kinds)])
    # as one text, since building each literal on its own took longer than counting millions of rows
    text = json.dumps([[{f"k{j}": v for j, v in enumerate(p)} for p in own] for own in pivots], default=str)
    lists = F.from_json(F.lit(text), ArrayType(ArrayType(key)))
    pivot = lambda i: F.get(F.get(lists, at), i)
    steps = [1 << b for b in reversed(range(max(map(len, pivots)).bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(step) for step in steps]), F.lit(0),
        lambda low, step: F.when(pivot(low + step - 1) < _struct(cols), low + step).otherwise(low),
    )
    # bound once, as the search would be written out at each use otherwise
    return F.get(F.transform(F.array(below), lambda i: 2 * i + F.coalesce((pivot(i) == _struct(cols)).cast("int"), F.lit(0))), F.lit(0))


def _numbered(
    df: DataFrame, opened: Sequence[_Open], within: Sequence[str], cols: Sequence[Column], pivots: Sequence[Sequence[Key]] | None = None
) -> DataFrame:
    """The rows of open intervals as (at, key columns, bucket); intervals do not overlap, so at most once a row."""
    keys = [c.alias(f"_k{j}") for j, c in enumerate(cols)]
    kinds = [f.dataType for f in df.select(*keys).schema]
    at = _interval(opened, {name: df.schema[name].dataType for name in within}, cols, kinds)
    rows = df.select(at.alias("_at"), *keys).filter(F.col("_at").isNotNull())
    if pivots is None:
        return rows
    if not any(pivots):
        return rows.withColumn("_bucket", F.lit(0))
    return rows.withColumn("_bucket", _bucket(pivots, F.col("_at"), [F.col(f"_k{j}") for j in range(len(cols))], kinds))


def group_sizes(df: DataFrame, within: Sequence[str] = ()) -> dict[tuple, int]:
    """Rows per group; ``within`` takes columns with a short fixed list of values."""
    rows = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).collect()
    return {tuple(r[:-1]): r[-1] for r in rows if r[-1]}


def rows_at(
    df: DataFrame, order: Sequence[Column], wanted: Mapping[tuple, Iterable[int]], sizes: Mapping[tuple, int],
    within: Sequence[str] = (),
) -> dict[tuple[tuple, int], Key]:
    """The order key of the rows at the places (from 1) asked for in each group: {(group, place): key}.

    ``order`` must be non-null. Rows with equal keys may be many: a pivot's own rows are counted apart.
    """
    found: dict[tuple[tuple, int], Key] = {}
    todo = {(g, r): _Open(g, None, None, 0, sizes[g]) for g, places in wanted.items() for r in places}
    while True:
        opened = sorted({o for o in todo.values() if o.size > LEAF}, key=lambda o: (repr(o.group), o.before))
        if not opened:
            break
        pivots = _pivots(df, opened, within, order)
        counted = _numbered(df, opened, within, order, pivots)
        counts = {(r["_at"], r["_bucket"]): r["count"] for r in counted.groupBy("_at", "_bucket").count().collect()}
        place = {o: i for i, o in enumerate(opened)}
        for target, o in list(todo.items()):
            if o not in place:
                continue
            narrowed = _narrow(o, pivots[place[o]], place[o], counts, target[1])
            if isinstance(narrowed, _Open):
                todo[target] = narrowed
            else:
                found[target] = narrowed
                del todo[target]
    leaves = sorted(set(todo.values()), key=lambda o: (repr(o.group), o.before))
    if leaves:
        place = {o: i for i, o in enumerate(leaves)}
        picks = sorted({(place[o], r - o.before) for (_, r), o in todo.items()})
        held = _numbered(df, leaves, within, order)
        keys = [f"_k{j}" for j in range(len(order))]
        sorted_rows = held.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("_rows"))
        asked = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(p).alias("p")) for i, p in picks])
        mine = F.filter(asked, lambda x: x["a"] == F.col("_at"))
        got = sorted_rows.select(
            "_at", F.inline(F.transform(mine, lambda x: F.struct(x["p"].alias("p"), F.element_at("_rows", x["p"]).alias("key"))))
        ).collect()
        keyed = {(r["_at"], r["p"]): tuple(r["key"]) for r in got}
        for (g, r), o in todo.items():
            found[(g, r)] = keyed[(place[o], r - o.before)]
    return found


def _place_of(key: Key) -> list:
    """Sorts like Spark: NaN comes after all numbers."""
    return [(x != x, x) for x in key]


def _pivots(df: DataFrame, opened: Sequence[_Open], within: Sequence[str], order: Sequence[Column]) -> list[list[Key]]:
    """Some rows of each open interval, in order: about SAMPLE times as many are drawn, every SAMPLE-th is taken.

    Any pivots give the same result, so a repeated task may draw others; none drawn costs one more pass.
    """
    many = max(1, min(PIVOTS, TREE_NODES // len(opened)))
    drawn = _numbered(df, opened, within, order)
    share = F.lit(1.0)
    for i, o in enumerate(opened):
        share = F.when(F.col("_at") == i, F.lit(min(1.0, many * SAMPLE / o.size))).otherwise(share)
    rows = drawn.filter(F.rand() < share).collect()
    picked = []
    for i in range(len(opened)):
        mine = sorted((tuple(r[1:]) for r in rows if r["_at"] == i), key=_place_of)
        picked.append(sorted(set(mine[SAMPLE // 2::SAMPLE] or mine[:1]), key=_place_of))
    return picked


def _narrow(o: _Open, pivots: Sequence[Key], at: int, counts: Mapping, place: int) -> _Open | Key:
    before = o.before
    for b in range(2 * len(pivots) + 1):
        n = counts.get((at, b), 0)
        if before + n >= place:
            if b % 2:
                return pivots[b // 2]
            low = pivots[b // 2 - 1] if b else o.low
            high = pivots[b // 2] if b // 2 < len(pivots) else o.high
            return _Open(o.group, low, high, before, n)
        before += n
    raise RuntimeError("the frame changed between passes: hand in a stored one")


def ntile_ends(size: int, bins: int) -> list[int]:
    """Last place of every SQL NTILE tile but the last: the first ``size mod bins`` tiles hold one row more."""
    base, rest = divmod(size, bins)
    return [i * base + min(i, rest) for i in range(1, bins)]


def quantile_ends(size: int, bins: int) -> list[int]:
    """Last place of every bin but the last of a right-closed cut of the places 1..size by interpolated edges."""
    return [(i * max(size - 1, 1)) // bins + 1 for i in range(1, bins)]


def quantile_places(size: int, p: float) -> tuple[int, int, float]:
    """The two neighbouring places of an interpolated quantile and the way between them."""
    at = (size - 1) * p
    low = floor(at)
    return low + 1, min(low + 2, size), at - low
