"""Effect of late delivery on buying again: study table, score, diagnostics, estimates."""

from __future__ import annotations

from functools import reduce
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.fixed_values import DELAY_MEDIUM, DELAY_ON_TIME, DELAY_SEVERE, DELAY_SLIGHT
from cartlens.functions.scalars import flag, plain_ratio
from cartlens.functions.tails import normal_tail
from cartlens.operators.features import PERSON
from cartlens.operators.ordered import bin_number, global_rank
from cartlens.session import written

NUMERIC = ("total_spend", "avg_review_score")
CODED = ("main_category", "customer_state", "main_payment_type")
MISSING = "None"


def label_codes(df: DataFrame, column: str, missing: str = MISSING) -> DataFrame:
    """Adds ``<column>_encoded``: the place of the label in alphabetical order, from zero.

    Labels are ranked in range partitions, however many there are. The code table is written, so its true
    size decides whether it is broadcast; a label held by a large share of the rows then moves no row.
    """
    text = F.coalesce(F.col(column), F.lit(missing))
    labels = df.select(text.alias("_label")).distinct()
    ranked = global_rank(labels, ["_label"], rank="_rank", size="_labels")
    codes = written(ranked.select("_label", (F.col("_rank") - 1).cast("int").alias(f"{column}_encoded")), "codes")
    return df.withColumn("_label", text).join(codes, "_label").drop("_label")


def covariates(df: DataFrame) -> list[str]:
    return [*NUMERIC, *[f"{c}_encoded" for c in CODED if f"{c}_encoded" in df.columns]]


def psm_prepare(features: DataFrame) -> DataFrame:
    """Treatment (any late order), outcome (bought again), covariates; rows with a missing one leave."""
    rows = features.withColumns(
        {
            "treatment": flag(F.col("delayed_order_ratio") > 0),
            "is_repeat_purchaser": flag(F.col("total_orders") > 1),
        }
    )
    for c in CODED:
        if c in features.columns:
            rows = label_codes(rows, c)
    return rows.na.drop(subset=[*covariates(rows), "treatment", "is_repeat_purchaser"])


def psm_sample_size(study: DataFrame) -> DataFrame:
    return study.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("treatment") == 1).alias("treatment"),
        F.count_if(F.col("treatment") == 0).alias("control"),
    )


def _outcome_mean(group: Column) -> Column:
    return F.coalesce(plain_ratio(F.sum(F.when(group, F.col("is_repeat_purchaser"))), F.count_if(group)), F.lit(0.0))


def psm_descriptive(study: DataFrame) -> DataFrame:
    control, treated = _outcome_mean(F.col("treatment") == 0), _outcome_mean(F.col("treatment") == 1)
    return study.agg(
        control.alias("control_repurchase_rate"),
        treated.alias("treatment_repurchase_rate"),
        (treated - control).alias("naive_difference"),
    )


def delay_group(delay: Column) -> Column:
    return (
        F.when(delay <= 0, DELAY_ON_TIME).when(delay <= 3, DELAY_SLIGHT).when(delay <= 7, DELAY_MEDIUM)
        .when(delay > 7, DELAY_SEVERE)
    )


def psm_delay_bins(study: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return (
        study.filter(F.col("avg_delivery_delay").isNotNull())
        .groupBy(delay_group(F.col("avg_delivery_delay")).alias("delay_group"))
        .agg(n.alias("users"), plain_ratio(F.sum("is_repeat_purchaser"), n).alias("repurchase_rate"))
    )


def psm_score(study: DataFrame, inputs: Sequence[str] | None = None, c: float = 1.0) -> DataFrame:
    """Adds ``propensity_score``: logistic regression with an L2 term of weight 1/(c n) on raw covariates."""
    inputs = list(inputs or covariates(study))
    n = study.count()
    vector = VectorAssembler(inputCols=inputs, outputCol="_x")
    ready = vector.transform(study.withColumns({i: F.col(i).cast("double") for i in inputs}))
    fit = LogisticRegression(
        featuresCol="_x", labelCol="treatment", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
        standardization=False, maxIter=1000, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_yes",
    ).fit(ready)
    return fit.transform(ready).select(
        *study.columns, vector_to_array("_p").getItem(1).alias("propensity_score")
    )


def psm_positivity(scored: DataFrame) -> DataFrame:
    ps = F.col("propensity_score")
    mean = lambda t: F.avg(F.when(F.col("treatment") == t, ps))
    return scored.agg(
        plain_ratio(F.count_if((ps > 0.1) & (ps < 0.9)), F.count(F.lit(1))).alias("positivity_ratio"),
        mean(1).alias("mean_treatment"),
        mean(0).alias("mean_control"),
    )


def psm_ps_hist(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Density of the score per group in equal-width bins of the group's own range."""
    ps = F.col("propensity_score")
    ranges = scored.groupBy("treatment").agg(F.min(ps).alias("lo"), F.max(ps).alias("hi"), F.count(ps).alias("n"))
    pair = lambda t: ranges.filter(F.col("treatment") == t).select(F.struct("lo", "hi").alias("s")).scalar()
    own = lambda f: F.when(F.col("treatment") == 1, pair(1)[f]).otherwise(pair(0)[f])
    counts = (
        scored.select("treatment", bin_number(ps, own("lo"), own("hi"), bins).alias("bin"))
        .groupBy("treatment", "bin").agg(F.count(F.lit(1)).alias("k"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(F.broadcast(counts), ["treatment", "bin"], "left").select(
        "treatment", "bin", (F.col("lo") + F.col("bin") * width).alias("lower_edge"),
        (F.coalesce("k", F.lit(0)) / (F.col("n") * F.nullif(width, F.lit(0.0)))).alias("density"),
    )


def psm_matched(study: DataFrame, pairs: DataFrame, id_col: str = PERSON) -> DataFrame:
    """The matched rows of both sides with their side and the treated id that names the pair."""
    roles = pairs.select(
        F.col("t_id").alias("pair_id"),
        F.inline(
            F.array(
                F.struct(F.col("t_id").alias("_id"), F.lit("treatment").alias("match_group")),
                F.struct(F.col("c_id").alias("_id"), F.lit("control").alias("match_group")),
            )
        ),
    )
    return study.join(roles, F.col(id_col) == F.col("_id")).drop("_id")


def _moments(rows: DataFrame, group: str, one: object, names: Sequence[str], tag: str) -> DataFrame:
    """|mean gap| over the pooled deviation, one row per covariate, from one aggregation."""
    is_one = F.col(group) == one
    parts = []
    for c in names:
        x = F.col(c).cast("double")
        a, b = F.when(is_one, x), F.when(~is_one, x)
        parts.append(
            F.struct(
                F.lit(c).alias("covariate"),
                F.abs(F.avg(a) - F.avg(b)).alias("gap"),
                F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2).alias("pooled"),
            )
        )
    smd = F.when(F.col("pooled") > 0, F.col("gap") / F.col("pooled")).otherwise(0.0)
    return rows.agg(F.array(*parts).alias("p")).select(F.inline("p")).select("covariate", smd.alias(tag))


def psm_balance(
    study: DataFrame, matched: DataFrame, names: Sequence[str] | None = None, limit: float = 0.1
) -> DataFrame:
    names = list(names or covariates(study))
    before = _moments(study, "treatment", 1, names, "smd_before")
    after = _moments(matched, "match_group", "treatment", names, "smd_after")
    return before.join(after, "covariate").withColumn("balanced", F.col("smd_after") < limit)


def outcome_cells(matched: DataFrame) -> DataFrame:
    """How many pairs show each of the four outcome combinations: all that the estimates need."""
    got = lambda side: F.max(F.when(F.col("match_group") == side, F.col("is_repeat_purchaser")))
    pairs = matched.groupBy("pair_id").agg(got("treatment").alias("t"), got("control").alias("c"))
    count = lambda t, c, name: F.count_if((F.col("t") == t) & (F.col("c") == c)).alias(name)
    return pairs.agg(count(1, 1, "n11"), count(1, 0, "n10"), count(0, 1, "n01"), count(0, 0, "n00"))


_PAIRS = lambda: F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")


def psm_att(cells: DataFrame) -> DataFrame:
    n = _PAIRS()
    t, c = plain_ratio(F.col("n11") + F.col("n10"), n), plain_ratio(F.col("n11") + F.col("n01"), n)
    return cells.select((t - c).alias("att"), t.alias("treatment_mean"), c.alias("control_mean"), n.alias("pairs"))


def psm_bootstrap(cells: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(replicate, att): resampled effects.

    Drawing pairs with replacement changes only the four cell counts, which are multinomial; each
    replicate draws them with its own seed.
    """
    runs = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                seen = np.array([row.n11, row.n10, row.n01, row.n00], dtype="int64")
                n = int(seen.sum())
                if n:
                    got = np.random.default_rng([seed, int(row.replicate)]).multinomial(n, seen / n)
                    out.append((int(row.replicate), float(got[1] - got[2]) / n))
            yield pd.DataFrame(out, columns=["replicate", "att"])

    return runs.mapInPandas(draw, "replicate int, att double")


def bootstrap_interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return draws.agg(
        F.percentile("att", low).alias("ci_lower"), F.percentile("att", high).alias("ci_upper"),
        F.count(F.lit(1)).alias("replicates"),
    )


def psm_rosenbaum(cells: DataFrame, gammas: Sequence[float] = (1.0, 1.25, 1.5, 2.0)) -> DataFrame:
    """Upper bound of the one-sided p-value when hidden bias may shift the odds by gamma."""
    rows = cells.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    split, plus = F.col("n10") + F.col("n01"), F.col("n10")
    p = F.col("gamma") / (1 + F.col("gamma"))
    spread = F.sqrt(split * p * (1 - p))
    z = (plus - split * p) / F.nullif(spread, F.lit(0.0))
    rows = rows.select("gamma", split.alias("discordant"), plus.alias("positive"), z.alias("z"))
    bound = F.coalesce(normal_tail(F.col("z")), F.lit(0.5))
    return rows.withColumn("p_upper_bound", bound).withColumn("significant", F.col("p_upper_bound") < 0.05)


def psm_roi(study: DataFrame, effect: DataFrame, shares: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Buyers won back and revenue if a share of late deliveries were avoided."""
    att = effect.select("att").scalar()
    base = study.agg(
        F.count_if(F.col("treatment") == 1).alias("delayed_users"),
        plain_ratio(F.sum("total_spend"), F.count("total_spend")).alias("avg_customer_value"),
    )
    rows = base.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("optimization_ratio"))
    won = F.floor(F.col("delayed_users") * F.abs(att) * F.col("optimization_ratio")).cast("bigint")
    return rows.withColumn("rescued_users", won).withColumn(
        "incremental_revenue", F.col("rescued_users") * F.col("avg_customer_value")
    )


def causal_document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with one struct (or list of structs) per part, for a nested JSON file."""
    columns = {
        name: df.agg(F.collect_list(F.struct(*df.columns)).alias("rows")) for name, df in parts.items()
    }
    first, *rest = columns.items()
    start = first[1].select(F.col("rows").alias(first[0]))
    return reduce(lambda acc, kv: acc.withColumn(kv[0], kv[1].scalar()), rest, start)
