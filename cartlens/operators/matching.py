"""One-to-one nearest-neighbour matching on a score, without replacement.

Meaning: treated rows take turns by id; each takes, among its ``k`` nearest controls (by distance,
then control id) within the caliper, the nearest one nobody took before. Taking turns is serial, so
the same pairs are found by deferred acceptance: every free treated row asks its next candidate, a
control keeps the asker with the smallest id, and the rest ask on. All controls agree on the order
of askers, so the stable result is unique and equals the serial one.

Nothing is paired within groups of equal scores. Of the treated rows with one score only the first
``k`` can ever find a partner, because they share one list of ``k`` candidates; and of the controls
with one score only the first ``k`` by id can stand on any list. Both cuts are exact and bound the
rows per score, whatever share of the data holds that score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.operators.ordered import range_sorted
from cartlens.session import written

_LOG_PARTS = 24

def _first_per_score(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids per score; the rank limit also applies before the shuffle."""
    place = F.row_number().over(Window.partitionBy("score").orderBy("id"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def _side(rows: DataFrame, wanted: Column, id_col: str, score: str, k: int) -> DataFrame:
    picked = rows.filter(wanted & F.col(score).isNotNull())
    return _first_per_score(picked.select(F.col(id_col).alias("id"), F.col(score).cast("double").alias("score")), k)


def match_candidates(
    rows: DataFrame, id_col: str, treated: str, score: str, caliper: float, k: int = 10
) -> DataFrame:
    """(t_id, place, c_ids, gaps): up to ``k`` controls per treated row within the caliper, nearest first.

    Treated and controls share one global order by score, in which a running count ranks the controls. With at most
    ``k`` controls per score, the ``k`` nearest of a treated row with ``c`` controls below it lie among the ranks
    c-2k+2 .. c+k. So each control gathers its neighbours by a window of bounded length, and treated rows carry on the
    gathering of the last control before them, however many stand in one gap. Windows stay within the partitions of
    the order; a halo of at most 3k controls a partition, and a rank 0 before the first, serve their borders.
    ``place`` numbers the treated rows in score order.
    """
    flagged = F.col(treated) == 1
    side = lambda rows_, control: rows_.withColumn("is_control", F.lit(control))
    both = side(_side(rows, flagged, id_col, score, k), 0).unionByName(side(_side(rows, ~flagged, id_col, score, k), 1))
    line = range_sorted(both, ["score", "is_control", "id"])
    parts = line.groupBy("_part").agg(F.sum("is_control").alias("controls"), F.sum(1 - F.col("is_control")).alias("askers"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(parts.select(
        "_part", "controls", F.coalesce(F.sum("controls").over(earlier), F.lit(0)).alias("c_before"),
        F.coalesce(F.sum("askers").over(earlier), F.lit(0)).alias("t_before"),
    ), "match-parts")
    so_far = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = written(line.join(F.broadcast(sums), "_part").select(
        "_part", "id", "score", "is_control", (F.sum("is_control").over(so_far) + F.col("c_before")).alias("rank"),
        (F.sum(1 - F.col("is_control")).over(so_far) + F.col("t_before")).alias("place"),
    ), "match-line")
    before = F.sequence(F.col("c_before") - (2 * k - 2), F.col("c_before"))
    after = F.sequence(F.col("c_before") + F.col("controls") + 1, F.col("c_before") + F.col("controls") + k)
    needs = sums.select("_part", F.explode(F.filter(F.concat(before, after), lambda r: r >= 0)).alias("rank"))
    controls = ranked.filter("is_control = 1")
    halo = controls.select("rank", "id", "score").join(F.broadcast(needs.filter("rank > 0")), "rank").select("_part", "rank", "id", "score")
    start = needs.filter("rank = 0").select("_part", "rank", F.lit(None).cast(dict(both.dtypes)["id"]).alias("id"), F.lit(None).cast("double").alias("score"))
    known = controls.select("_part", "rank", "id", "score").unionByName(halo).unionByName(start)
    some = F.when(F.col("id").isNotNull(), F.struct(F.col("id").alias("c_id"), F.col("score").alias("c_score")))
    near = F.collect_list(some).over(Window.partitionBy("_part").orderBy("rank").rowsBetween(-(2 * k - 2), k))
    askers = ranked.filter("is_control = 0").select("_part", "rank", "id", "score", "place", F.lit(None).cast(
        f"array<struct<c_id: {dict(both.dtypes)['id']}, c_score: double>>").alias("around"), F.lit(1).alias("turn"))
    gathered = known.withColumns({"around": near, "place": F.lit(None).cast("bigint"), "turn": F.lit(0)})
    carried = F.last("around", ignorenulls=True).over(
        Window.partitionBy("_part").orderBy("rank", "turn").rowsBetween(Window.unboundedPreceding, 0))
    asking = gathered.unionByName(askers).withColumn("around", carried).filter("turn = 1").select(
        F.col("id").alias("t_id"), F.col("score").alias("t_score"), "place", "around")
    gap = lambda c: F.abs(c["c_score"] - F.col("t_score"))
    within = F.filter(
        F.transform("around", lambda c: F.struct(gap(c).alias("gap"), c["c_id"].alias("c_id"))),
        lambda w: w["gap"] <= caliper,
    )
    return (
        asking.select("t_id", "place", F.slice(F.array_sort(within), 1, k).alias("wishes"))
        .filter(F.size("wishes") > 0)
        .select("t_id", "place", F.col("wishes.c_id").alias("c_ids"), F.col("wishes.gap").alias("gaps"))
    )


def _settled(state: DataFrame, block_rows: int, shift: int) -> DataFrame:
    """Rows (t_id, place, c_ids, turn) that hold a control after each block of neighbours has settled by itself.

    The rows of a block ask in id order, each from its present wish on; those that find nothing drop out.
    """
    id_type = dict(state.dtypes)["t_id"]
    lists = state.groupBy(F.floor((F.col("place") + shift) / block_rows).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("t_id", "place", "c_ids", "turn"))).alias("rows"))
    left = lambda row: F.slice(row["c_ids"], row["turn"], F.greatest(F.size(row["c_ids"]) - row["turn"] + 1, F.lit(0)))
    free = lambda taken, row: F.get(F.filter(left(row), lambda c: ~F.coalesce(F.array_contains(taken, c), F.lit(False))), F.lit(0))
    given = F.aggregate("rows", F.array().cast(f"array<{id_type}>"), lambda taken, row: F.concat(taken, F.array(free(taken, row))))
    told = lists.select("rows", given.alias("given")).select(F.explode(F.arrays_zip("rows", "given")).alias("e"))
    return told.filter("e.given is not null").select(
        "e.rows.t_id", "e.rows.place", "e.rows.c_ids", F.col("e.given").alias("c_id"),
        F.array_position(F.col("e.rows.c_ids"), F.col("e.given")).cast("int").alias("turn"))


def _contested(held: DataFrame) -> DataFrame:
    """(c_id, winner) of the controls that several rows hold."""
    return held.groupBy("c_id").agg(F.min("t_id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("c_id", "winner")


def resolve(candidates: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Deferred acceptance over (t_id, place, c_ids, gaps); gives (t_id, c_id, gap).

    The order in which rows ask does not change the result, so blocks of neighbouring treated rows first settle among
    themselves, once, and once more with the borders moved by half a block where blocks disagree. After that only rows
    that were refused go on: they ask their next control, which compares them with its holder. A control only ever changes
    to a holder with a smaller id, so acceptances are appended to a log and the holder is the smallest id in it; nothing
    settled is written again. It is over when nobody asks.
    """
    wishes = written(candidates, "match-wishes")
    held = written(_settled(wishes.select("t_id", "place", "c_ids", F.lit(1).alias("turn")), block_rows, 0), "match-holders")
    contested = written(_contested(held), "match-contested")
    if not contested.isEmpty():
        lost = F.col("winner").isNotNull() & (F.col("winner") != F.col("t_id"))
        again = held.join(contested, "c_id", "left").withColumn("turn", F.col("turn") + lost.cast("int"))
        held = written(_settled(again.select("t_id", "place", "c_ids", "turn"), block_rows, block_rows // 2), "match-holders")
        contested = written(_contested(held), "match-contested")
    log = [held.select("t_id", "c_id", "turn")]
    refused = log[0].join(contested, "c_id").filter("t_id <> winner").select("t_id", "turn")
    while True:
        ask = F.col("turn") + 1
        pending = wishes.select("t_id", "c_ids").join(refused, "t_id").filter(ask <= F.size("c_ids")).select(
            "t_id", F.get("c_ids", F.col("turn")).alias("c_id"), ask.alias("turn"))
        holder = reduce(DataFrame.unionByName, log).join(pending.select("c_id").distinct(), "c_id").groupBy("c_id").agg(
            F.min_by(F.struct("t_id", "turn"), "t_id").alias("h"))
        both = pending.withColumn("fresh", F.lit(True)).unionByName(holder.select("h.t_id", "c_id", "h.turn", F.lit(False).alias("fresh")))
        kept = F.col("t_id") == F.min("t_id").over(Window.partitionBy("c_id"))
        told = written(both.withColumn("kept", kept), "match-told")
        refused = told.filter(~F.col("kept")).select("t_id", "turn")
        log.append(told.filter("fresh and kept").select("t_id", "c_id", "turn"))
        if refused.isEmpty():
            break
        if len(log) > _LOG_PARTS:
            log = [written(reduce(DataFrame.unionByName, log), "match-holders")]
    final = reduce(DataFrame.unionByName, log).groupBy("c_id").agg(F.min_by(F.struct("t_id", "turn"), "t_id").alias("h"))
    settled = final.select("c_id", "h.t_id", "h.turn")
    return settled.join(wishes.select("t_id", "gaps"), "t_id").select("t_id", "c_id", F.element_at("gaps", F.col("turn")).alias("gap"))


def match_pairs(
    rows: DataFrame, id_col: str, treated: str = "treatment", score: str = "propensity_score",
    caliper: float = 0.05, k: int = 10,
) -> DataFrame:
    return resolve(match_candidates(rows, id_col, treated, score, caliper, k))


def match_widened(
    rows: DataFrame, id_col: str, treated: str = "treatment", score: str = "propensity_score",
    caliper: float = 0.05, wide: float = 0.1, least: float = 0.5, k: int = 10,
) -> tuple[DataFrame, float, float]:
    """Pairs, caliper used and match rate; starts over with the wide caliper when too few match."""
    total = rows.filter(F.col(treated) == 1).count()
    pairs, used = match_pairs(rows, id_col, treated, score, caliper, k), caliper
    rate = pairs.count() / total if total else 0.0
    if rate < least:
        pairs, used = match_pairs(rows, id_col, treated, score, wide, k), wide
        rate = pairs.count() / total if total else 0.0
    return pairs, used, rate
