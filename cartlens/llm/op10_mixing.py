"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are added up by membership pattern (the set of sources that hold them). In the flow network each
pattern may send its size once at cost 0, a second time at cost 1, and so on (convex: no document is repeated
while one that its sources could use is unused), to the sources of the pattern; each source takes its target.
The solved flow says how many words every pattern gives. All its documents are taken as often as the flow
covers the whole pattern; the rest is filled with whole documents in seeded hash order, and what the first
document that doesn't fit leaves open is filled with smaller ones.

Size: targets and patterns are sums (partial sums before each shuffle), seeded order and running sums are range
partitioned (``ordered.running_totals``), so a source with a third of all rows spreads over many tasks. Only
patterns reach the driver, and no more than ``MAX_PATTERNS``; beyond, patterns whose source is in no other
pattern are settled by Spark (their flow is the smaller of quota and capacity), and more overlapping ones
raise ValueError.

Defined results: a null text has size 0; the null source is a source, last in order. Rows equal in document id,
sources and size share one decision, so repeated rows are taken alike. An empty table gives an empty one. Nothing
to share (all sizes 0): targets 0, nothing taken.
"""

from __future__ import annotations

from collections import deque
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.operators.ordered import global_rank, running_totals
from cartlens.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 17
MAX_PATTERNS = 2000
FINE = 8  # documents of at most an eighth of what is open fill it


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): ``share`` of all words by weight, capped.

    The level (words per unit of weight) rises until no uncapped source is above ``most`` times its size: each
    round is one aggregation over the sources.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], rank="_rank", size="_n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    weighted = written(ranked.select("source", "source_size", weight.alias("_weight")), "weighted")
    cap = F.col("source_size") * float(most)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = cap < F.col("_weight") * level
        fixed, open_weight = weighted.agg(
            F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_weight")))
        ).first()
        if not open_weight:
            break
        raised = (share * total - fixed) / open_weight
        if raised <= level:
            break
        level = raised
    return weighted.select("source", "source_size", F.least(cap, F.col("_weight") * level).alias("target"))


def min_cost_flow(sizes: list[int], members: list[list[int]], quotas: list[int], most: int) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources: most flow first, then least repetition cost.

    Successive shortest paths; pattern p has ``most`` arcs of capacity sizes[p] and costs 0, 1, 2, ...
    """
    n_p, n_s = len(sizes), len(quotas)
    begin, end = n_p + n_s, n_p + n_s + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[x].append(len(to))
            to.append(y), room.append(c), cost.append(w)
        return len(to) - 2

    links = []
    for p in range(n_p):
        for copy in range(most):
            arc(begin, p, sizes[p], copy)
        links.append({s: arc(p, n_p + s, most * sizes[p], 0) for s in members[p]})
    for s in range(n_s):
        arc(n_p + s, end, quotas[s], 0)
    while True:
        away, came, waiting, queued = {begin: 0}, {}, deque([begin]), {begin}
        while waiting:
            x = waiting.popleft()
            queued.discard(x)
            for e in arcs[x]:
                if room[e] and away[x] + cost[e] < away.get(to[e], 1 << 60):
                    away[to[e]], came[to[e]] = away[x] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        waiting.append(to[e])
        if end not in away:
            return [{s: room[e ^ 1] for s, e in link.items()} for link in links]
        push, x = None, end
        while x != begin:
            push = room[came[x]] if push is None else min(push, room[came[x]])
            x = to[came[x] ^ 1]
        x = end
        while x != begin:
            room[came[x]] -= push
            room[came[x] ^ 1] += push
            x = to[came[x] ^ 1]


def routed(units: DataFrame, goals: DataFrame, most: int = MOST_REPEATS) -> tuple[DataFrame, bool]:
    """_pattern, _words (its size), _given (words the flow sends from it), and whether they are MAX_PATTERNS rows at
    most. ``units``: _pattern, _sources, _total."""
    spark = units.sparkSession
    patterns = written(units.groupBy("_pattern").agg(F.first("_sources").alias("_sources"), F.sum("_total").alias("_words")), "patterns")
    aims = goals.select("source", F.round("target").cast("long").alias("_quota"))
    settled = None
    flowing = patterns
    if patterns.limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        held = patterns.select("_pattern", F.explode("_sources").alias("source"))
        alone = held.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.first("_pattern").alias("_pattern"))
        alone = alone.filter("_n = 1").join(patterns.filter(F.size("_sources") == 1), "_pattern")
        on = alone["source"].eqNullSafe(aims["source"])
        settled = alone.join(aims, on).select(
            "_pattern", "_words", F.least(F.col("_quota"), F.col("_words") * most).alias("_given")
        )
        flowing = patterns.join(settled.select("_pattern"), "_pattern", "left_anti")
    rows = flowing.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} overlapping membership patterns; merge sources first")
    named = spark.createDataFrame([(s,) for r in rows for s in r["_sources"]], "source string").distinct()
    near = aims.join(F.broadcast(named), aims["source"].eqNullSafe(named["source"]), "left_semi").collect()
    place = {r["source"]: i for i, r in enumerate(near)}
    flow = min_cost_flow(
        [r["_words"] for r in rows], [[place[s] for s in r["_sources"]] for r in rows], [r["_quota"] for r in near], most
    )
    solved = spark.createDataFrame(
        [(r["_pattern"], r["_words"], sum(f.values())) for r, f in zip(rows, flow)],
        "_pattern string, _words long, _given long",
    )
    return (solved, True) if settled is None else (solved.unionByName(settled), False)


def by_pattern(rows: DataFrame, values: DataFrame, few: bool) -> DataFrame:
    """Joins a row for each pattern: broadcast if the patterns were counted and are few, else left to the planner."""
    return rows.join(F.broadcast(values) if few else values, "_pattern")


def prefix_totals(rows: DataFrame, few: bool) -> DataFrame:
    """Adds _upto: the sum of _total within the pattern up to this unit in seeded order."""
    summed = running_totals(rows, ["_pattern", "_draw", "_id", "_size"], {"_run": "_total"})
    summed = written(summed, "totals")
    before = summed.groupBy("_pattern").agg(F.min(F.col("_run") - F.col("_total")).alias("_before"))
    return by_pattern(summed, before, few).withColumn("_upto", F.col("_run") - F.col("_before")).drop("_run", "_before")


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    memberships: str | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, targets). decisions: _id, _sources, _size, _n (equal rows), _copies (how often each is taken).

    ``memberships`` names an array column where documents belong to several sources; a source's size then
    counts every document that it holds. Patterns are sets: order and repeats in the array don't matter.
    """
    sources = F.array(F.col(f"`{source}`")) if memberships is None else F.array_sort(F.array_distinct(F.col(f"`{memberships}`")))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), sources.alias("_sources"), word_count(F.col(f"`{text}`")).alias("_size"))
    rows = rows.groupBy("_id", "_sources", "_size").agg(F.count(F.lit(1)).alias("_n"))
    units = written(
        rows.select(
            "*", (F.col("_size") * F.col("_n")).alias("_total"), F.to_json("_sources").alias("_pattern"),
            F.xxhash64(F.lit(seed), F.col("_id"), F.col("_size")).alias("_draw"),
        ), "units",
    )
    held = units.select(F.explode("_sources").alias("source"), "_total")
    goals = written(targets(held.groupBy("source").agg(F.sum("_total").alias("source_size")), weights, share, most), "targets")
    flow, few = routed(units, goals, most)
    whole = F.floor(F.col("_given") / F.greatest(F.col("_words"), F.lit(1)))
    flow = flow.select("_pattern", whole.alias("_whole"), (F.col("_given") - whole * F.col("_words")).alias("_rest"))
    first = by_pattern(prefix_totals(units, few), flow, few)
    first = written(first.withColumn("_more", (F.col("_upto") <= F.col("_rest")).cast("long")), "first")
    gap = first.groupBy("_pattern").agg((F.max("_rest") - F.sum(F.col("_more") * F.col("_total"))).alias("_gap"))
    small = by_pattern(first.filter("_more = 0"), gap, few).filter(F.col("_total") * FINE <= F.col("_gap"))
    fill = prefix_totals(small.drop("_upto", "_more", "_whole", "_rest"), few).filter(F.col("_upto") <= F.col("_gap"))
    extra = fill.select("_pattern", "_draw", "_id", "_size")
    on = [first[c].eqNullSafe(extra[c]) for c in ("_pattern", "_draw", "_id", "_size")]
    chosen = first.join(extra.withColumn("_extra", F.lit(1)), on, "left").select(
        first["_id"], first["_sources"], first["_size"], first["_n"],
        (first["_whole"] + first["_more"] + F.coalesce(F.col("_extra"), F.lit(0))).cast("int").alias("_copies"),
    )
    return chosen, goals


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mixed rows with all their columns: a document taken twice comes twice, one not taken not at all."""
    names, docs = docs.columns, docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])  # no name can clash
    doc_id, text, source = (f"_in{names.index(c)}" for c in (doc_id, text, source))
    chosen, _ = mixed(docs, doc_id, text, source, **settings)
    chosen = chosen.select(
        F.col("_id").alias("_mix_id"), F.element_at("_sources", 1).alias("_mix_source"), F.col("_size").alias("_mix_size"), F.col("_copies").alias("_mix_copies")
    ).filter("_mix_copies > 0")
    sized = docs.withColumn("_mix_words", word_count(F.col(f"`{text}`")))
    on = (
        sized[f"`{doc_id}`"].eqNullSafe(chosen["_mix_id"])
        & sized[f"`{source}`"].eqNullSafe(chosen["_mix_source"])
        & (sized["_mix_words"] == chosen["_mix_size"])
    )
    rows = sized.join(chosen, on).withColumn("_mix_again", F.explode(F.array_repeat(F.lit(0), F.col("_mix_copies"))))
    return rows.select(*docs.columns).toDF(*names)


@query("op10_mixing")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    chosen, goals = mixed(table(spark, folder, "documents"))
    rows = chosen.withColumn("source", F.element_at("_sources", 1)).withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))))
    return rows.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), "source",
    )
