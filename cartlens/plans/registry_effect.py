"""Registered queries: the effect of late delivery.

The fitted score depends on a solver, so the queries that follow from it are registered twice over:
``psm_score`` and ``psm_fitted_*`` on the fitted score, the others on a score of whole numbers made from
the spend and the key, which both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import effect, matching
from cartlens.operators.features import PERSON
from cartlens.plans import oracle as o
from cartlens.plans.registry import FEATURES, on, query, wide_features
from cartlens.session import written

STUDY, STUDY_WIDE = o.study_tables(0.05), o.study_tables(0.1)
CALIPER = 0.05


def study(s):
    return written(effect.psm_prepare(written(wide_features(s), "features")), "study")


def scored(s):
    cents = F.round(F.col("total_spend") * 100).cast("bigint")
    number = (cents * 7 + F.col(PERSON) * 7919) % 100003
    return study(s).withColumn("propensity_score", number.cast("double") / 100003)


def pairs(rows):
    return matching.match_pairs(rows, PERSON, caliper=CALIPER)


def matched(s):
    rows = scored(s)
    return rows, effect.psm_matched(rows, pairs(rows))


def cells(s):
    return effect.outcome_cells(matched(s)[1])


query("psm_prepare", on(STUDY, """SELECT customer_unique_id, treatment, is_repeat_purchaser, total_spend, avg_review_score,
  main_category_encoded, main_payment_type_encoded FROM scored"""))(
    lambda s: study(s).select(
        PERSON, "treatment", "is_repeat_purchaser", "total_spend", "avg_review_score", "main_category_encoded",
        "main_payment_type_encoded",
    )
)
query("psm_sample_size", on(STUDY, """SELECT count(*) AS total, count(CASE WHEN treatment = 1 THEN 1 END) AS treatment,
  count(CASE WHEN treatment = 0 THEN 1 END) AS control FROM scored"""))(lambda s: effect.psm_sample_size(study(s)))

_RATE = "CAST(sum(CASE WHEN treatment = {0} THEN is_repeat_purchaser END) AS DOUBLE) / count(CASE WHEN treatment = {0} THEN 1 END)"
query("psm_descriptive", on(STUDY, f"""SELECT {_RATE.format(0)} AS control_repurchase_rate, {_RATE.format(1)} AS treatment_repurchase_rate,
  {_RATE.format(1)} - {_RATE.format(0)} AS naive_difference FROM scored"""))(lambda s: effect.psm_descriptive(study(s)))
query("psm_delay_bins", on(STUDY, """SELECT CASE WHEN avg_delivery_delay <= 0 THEN '准时' WHEN avg_delivery_delay <= 3 THEN '轻微延迟'
  WHEN avg_delivery_delay <= 7 THEN '中度延迟' ELSE '严重延迟' END AS delay_group, count(*) AS users,
  CAST(sum(is_repeat_purchaser) AS DOUBLE) / count(*) AS repurchase_rate FROM scored WHERE avg_delivery_delay IS NOT NULL GROUP BY 1"""))(
    lambda s: effect.psm_delay_bins(study(s))
)
query("psm_score")(
    lambda s: effect.psm_score(study(s)).select(PERSON, "treatment", F.round("propensity_score", 6).alias("propensity_score"))
)
_AVG = "round(avg(CASE WHEN treatment = {0} THEN propensity_score END), 8)"
query("psm_positivity", on(STUDY, f"""SELECT CAST(count(CASE WHEN propensity_score > 0.1 AND propensity_score < 0.9 THEN 1 END) AS DOUBLE) / count(*)
  AS positivity_ratio, {_AVG.format(1)} AS mean_treatment, {_AVG.format(0)} AS mean_control FROM scored"""))(
    lambda s: effect.psm_positivity(scored(s)).withColumns(
        {c: F.round(c, 8) for c in ("mean_treatment", "mean_control")}
    )
)
query("psm_ps_hist", on(STUDY, """, h AS (SELECT treatment, min(propensity_score) AS lo, max(propensity_score) AS hi, count(*) AS n
    FROM scored GROUP BY 1),
  b AS (SELECT s.treatment, least(CAST(floor((propensity_score - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, count(*) AS k
    FROM scored s JOIN h ON s.treatment = h.treatment GROUP BY 1, 2)
  SELECT h.treatment, r.bin, round(lo + r.bin * ((hi - lo) / 50), 8) AS lower_edge,
    round(coalesce(k, 0) / (n * ((hi - lo) / 50)), 6) AS density
  FROM h CROSS JOIN (SELECT unnest(range(50)) AS bin) r LEFT JOIN b ON b.treatment = h.treatment AND b.bin = r.bin""".lstrip()))(
    lambda s: effect.psm_ps_hist(scored(s)).withColumns(
        {"lower_edge": F.round("lower_edge", 8), "density": F.round("density", 6)}
    )
)
query("psm_match", on(STUDY, "SELECT t_id, c_id, gap FROM pairs"))(lambda s: pairs(scored(s)))


@query("psm_match_widen", on(STUDY_WIDE, "SELECT t_id, c_id, gap, CAST(0.1 AS DOUBLE) AS caliper FROM pairs"))
def _(s):
    """The fixture's controls are too few for the match rate asked for, so the wide caliper is used."""
    found, used, _rate = matching.match_widened(scored(s), PERSON, caliper=CALIPER)
    return found.withColumn("caliper", F.lit(used))


query("psm_matched", on(STUDY, """SELECT pair_id, match_group, customer_unique_id, treatment, is_repeat_purchaser, total_spend
  FROM matched"""))(
    lambda s: matched(s)[1].select("pair_id", "match_group", PERSON, "treatment", "is_repeat_purchaser", "total_spend")
)


def _smd(name: str) -> str:
    def side(table: str, group: str) -> str:
        x = lambda on: f"CASE WHEN {group} = {on} THEN CAST({name} AS DOUBLE) END"
        one, zero = ("1", "0") if group == "treatment" else ("'treatment'", "'control'")
        return f"""(SELECT coalesce(abs(avg({x(one)}) - avg({x(zero)}))
          / nullif(sqrt((var_samp({x(one)}) + var_samp({x(zero)})) / 2), 0), 0) FROM {table})"""

    after = side("matched", "match_group")
    return f"""SELECT '{name}' AS covariate, round({side('scored', 'treatment')}, 6) AS smd_before,
      round({after}, 6) AS smd_after, CASE WHEN {after} < 0.1 THEN 1 ELSE 0 END AS balanced"""


_COVARIATES = ("total_spend", "avg_review_score", "main_category_encoded", "main_payment_type_encoded")


@query("psm_balance", on(STUDY, "SELECT covariate, smd_before, smd_after, CAST(balanced AS BIGINT) AS balanced FROM ("
  + " UNION ALL ".join(_smd(c) for c in _COVARIATES) + ")"))
def _(s):
    rows, both = matched(s)
    return effect.psm_balance(rows, both).withColumns(
        {c: F.round(c, 6) for c in ("smd_before", "smd_after")}
    )


_N = "CAST(n11 + n10 + n01 + n00 AS DOUBLE)"
query("psm_att", on(STUDY, f"""SELECT (n11 + n10) / {_N} - (n11 + n01) / {_N} AS att, (n11 + n10) / {_N} AS treatment_mean,
  (n11 + n01) / {_N} AS control_mean, CAST(n11 + n10 + n01 + n00 AS BIGINT) AS pairs FROM cells"""))(
    lambda s: effect.psm_att(cells(s))
)
query("psm_bootstrap")(lambda s: effect.bootstrap_interval(effect.psm_bootstrap(cells(s))))
_Z = "(n10 - (n10 + n01) * (g / (1 + g))) / sqrt((n10 + n01) * (g / (1 + g)) * (1 - g / (1 + g)))"
query("psm_rosenbaum", on(STUDY, f"""SELECT g AS gamma, CAST(n10 + n01 AS BIGINT) AS discordant, CAST(n10 AS BIGINT) AS positive, round({_Z}, 8) AS z
  FROM cells CROSS JOIN (SELECT CAST(unnest([1.0, 1.25, 1.5, 2.0]) AS DOUBLE) AS g)"""))(
    lambda s: effect.psm_rosenbaum(cells(s)).select("gamma", "discordant", "positive", F.round("z", 8).alias("z"))
)
query("psm_rosenbaum_p")(lambda s: effect.psm_rosenbaum(cells(s)))


@query("psm_roi", on(STUDY, f""", a AS (SELECT abs((n11 + n10) / {_N} - (n11 + n01) / {_N}) AS att FROM cells),
  b AS (SELECT count(CASE WHEN treatment = 1 THEN 1 END) AS delayed_users,
    CAST(sum(CAST(total_spend AS DECIMAL(18,2))) AS DOUBLE) / count(total_spend) AS avg_customer_value FROM scored)
  SELECT delayed_users, avg_customer_value, r AS optimization_ratio, CAST(floor(delayed_users * att * r) AS BIGINT) AS rescued_users,
    floor(delayed_users * att * r) * avg_customer_value AS incremental_revenue
  FROM a CROSS JOIN b CROSS JOIN (SELECT CAST(unnest([0.3, 0.5, 0.7]) AS DOUBLE) AS r)""".lstrip()))
def _(s):
    rows, both = matched(s)
    return effect.psm_roi(rows, effect.psm_att(effect.outcome_cells(both)))


@query("psm_fitted_study")
def _(s):
    """The whole study on the fitted score: match rate, balance and effect in one row per covariate."""
    rows = written(effect.psm_score(study(s)), "scored")
    found, used, rate = matching.match_widened(rows, PERSON, caliper=CALIPER)
    both = written(effect.psm_matched(rows, found), "matched")
    att = effect.psm_att(effect.outcome_cells(both)).select("att").scalar()
    return effect.psm_balance(rows, both).select(
        "covariate", F.round("smd_before", 4).alias("smd_before"), F.round("smd_after", 4).alias("smd_after"),
        F.lit(used).alias("caliper"), F.lit(round(rate, 6)).alias("match_rate"), F.round(att, 6).alias("att"),
    )
