"""Registered queries: clustering and churn models.

Fitted models depend on solvers and are checked by their invariants in the tests; everything around
them is checked by value on scores and labels made from the keys. Tree counts are those of the job.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cartlens import fixed_values as fv
from cartlens.functions.scalars import hash_unit
from cartlens.operators import churn_model as cm
from cartlens.operators import cluster as cl
from cartlens.operators import rfm
from cartlens.operators.features import FEATURE_ORDER, PERSON
from cartlens.plans import oracle as o
from cartlens.plans.registry import FEATURES, labels, on, query, wide_features
from cartlens.session import scratch_path, written

TREES = 200
CLUSTER = cl.CLUSTER_FEATURES


def filled(s):
    return cl.impute_median(written(wide_features(s, columns=CLUSTER), "features"))


def vectors(s):
    return written(cl.as_vectors(cl.standardize(written(filled(s), "filled"))), "vectors")


_FILLED = ", fi AS (SELECT customer_unique_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM features)) AS {c}" for c in CLUSTER) + " FROM features)"

query("impute_median", on(FEATURES + _FILLED, "SELECT * FROM fi"))(filled)
query("standardize", on(FEATURES + _FILLED, "SELECT customer_unique_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM fi)) / (SELECT stddev_pop({c}) FROM fi), 6) AS {c}" for c in CLUSTER) + " FROM fi"))(
    lambda s: cl.standardize(written(filled(s), "filled")).select(PERSON, *[F.round(c, 6).alias(c) for c in CLUSTER])
)
query("kmeans_elbow")(lambda s: (lambda v: cl.kmeans_elbow(v, cl.kmeans_scan(v)))(vectors(s)))
query("kmeans_silhouette")(lambda s: (lambda v: cl.kmeans_silhouette(v, cl.kmeans_scan(v)))(vectors(s)))


@query("kmeans_assign")
def _(s):
    v = vectors(s)
    models = cl.kmeans_scan(v)
    best = cl.kmeans_silhouette(v, models).filter("is_best").first()["k"]
    return cl.kmeans_assign(v, models[best]).groupBy("cluster").agg(F.count(F.lit(1)).alias("users"))


@query("pca2")
def _(s):
    points, shares = cl.pca2(vectors(s))
    spread = points.agg(F.var_samp("pc1").alias("pc1"), F.var_samp("pc2").alias("pc2"))
    return shares.withColumn("variance", F.when(F.col("component") == "pc1", spread.select("pc1").scalar()).otherwise(
        spread.select("pc2").scalar()))


_KEYED = _FILLED + ", cu AS (SELECT *, customer_unique_id % 4 AS cluster FROM fi)"
query("cluster_profile", on(FEATURES + _KEYED + ", me AS (SELECT cluster, "
  + ", ".join(f"avg({c}) AS {c}" for c in CLUSTER) + ", count(*) AS users FROM cu GROUP BY 1)",
  "SELECT cluster, users, " + ", ".join(
    f"round({c}, 6) AS {c}, round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 5) AS {c}_z" for c in CLUSTER) + " FROM me"))(
    lambda s: cl.cluster_profile(filled(s).withColumn("cluster", F.col(PERSON) % 4)).select(
        "cluster", "users", *[F.round(c, 6).alias(c) for c in CLUSTER], *[F.round(f"{c}_z", 5).alias(f"{c}_z") for c in CLUSTER]
    )
)
_SEGMENTS = [fv.SEGMENT_HIGH_VALUE, fv.SEGMENT_KEEP, fv.SEGMENT_WAKE, fv.SEGMENT_AT_RISK]


def segmented(s):
    return rfm.with_rfm(written(wide_features(s), "features"))


query("cluster_crosstab", on(FEATURES, "SELECT coalesce(CAST(cluster AS VARCHAR), '合计') AS cluster, " + ", ".join(
    f"count(CASE WHEN rfm_segment = '{g}' THEN 1 END) AS \"{g}\"" for g in _SEGMENTS)
  + ", count(*) AS \"合计\" FROM (SELECT customer_unique_id % 4 AS cluster, rfm_segment FROM segments) GROUP BY ROLLUP (cluster)"))(
    lambda s: cl.cluster_crosstab(segmented(s).withColumn("cluster", F.col(PERSON) % 4), _SEGMENTS)
)


# --- churn models ----------------------------------------------------------------------------

def labelled(s):
    base = segmented(s)
    return written(base.join(labels(s, base).select(PERSON, "is_churned"), PERSON), "labelled")


def table(s):
    df, names = cm.ml_table(labelled(s))
    return written(df, "ml-table"), names


_NAMES = [c for c in (*FEATURE_ORDER, "rfm_r_score", "rfm_f_score", "rfm_m_score") if "date" not in c]
_TEXTS = ("main_category", "main_payment_type")
_CODE = lambda c: (
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1 AS DOUBLE) AS {c}" if c in _TEXTS
    else f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}"
)
_TABLE = f""", ml AS (SELECT customer_unique_id, CAST(is_churned AS DOUBLE) AS is_churned, {', '.join(_CODE(c) for c in _NAMES)}
  FROM (SELECT f.*, rfm_r_score, rfm_f_score, rfm_m_score, rfm_segment, is_churned FROM features f
    JOIN segments USING (customer_unique_id) JOIN labels_ USING (customer_unique_id)))"""
_UNIT = lambda salt: f"CAST(('0x' || substr(md5('{salt}' || CAST(customer_unique_id AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
_SPLIT = _TABLE + f""", sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY is_churned ORDER BY {_UNIT('split42:')}, customer_unique_id)
    <= round(count(*) OVER (PARTITION BY is_churned) * 0.2) THEN 'test' ELSE 'train' END AS split FROM ml)"""
_GUESS = _TABLE + f""", gu AS (SELECT customer_unique_id, is_churned, score, CAST(score >= 0.5 AS INTEGER) AS prediction FROM (
    SELECT customer_unique_id, is_churned, round(0.3 * is_churned + 0.7 * {_UNIT('score:')}, 3) AS score FROM ml))"""


def guesses(s):
    """Scores made from label and key, with many ties, in place of a model's."""
    df, _ = table(s)
    score = F.round(F.lit(0.3) * F.col("is_churned") + F.lit(0.7) * hash_unit(F.col(PERSON), "score:"), 3)
    return df.select(PERSON, "is_churned", score.alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("double")
    )


query("ml_feature_select", on(FEATURES, "SELECT unnest([" + ", ".join(f"'{c}'" for c in _NAMES) + "]) AS feature, count(*) AS rows FROM features"))(
    lambda s: (lambda df: df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(F.array(*[F.lit(c) for c in cm.ml_feature_select(df)])).alias("feature"), "rows"))(labelled(s))
)
query("ml_label_encode", on(FEATURES, """SELECT customer_unique_id, dense_rank() OVER (ORDER BY coalesce(main_category, 'unknown')) - 1 AS main_category,
  dense_rank() OVER (ORDER BY coalesce(main_payment_type, 'unknown')) - 1 AS main_payment_type FROM features"""))(
    lambda s: cm.ml_label_encode(written(wide_features(s), "features").select(PERSON, *_TEXTS), _TEXTS)
)
query("ml_fillna", on(FEATURES + _TABLE, "SELECT * FROM ml"))(lambda s: table(s)[0])
query("ml_churn_share", on(FEATURES, "SELECT count(*) AS rows, CAST(sum(is_churned) AS DOUBLE) / count(*) AS churn_rate FROM labels_"))(
    lambda s: cm.ml_churn_share(labels(s))
)
query("ml_split", on(FEATURES + _SPLIT, "SELECT customer_unique_id, is_churned, split FROM sp"))(
    lambda s: cm.ml_split(table(s)[0]).select(PERSON, "is_churned", "split")
)
query("ml_split_share", on(FEATURES + _SPLIT, "SELECT split, count(*) AS rows, sum(is_churned) / count(*) AS churn_rate FROM sp GROUP BY 1"))(
    lambda s: cm.ml_churn_share(cm.ml_split(table(s)[0]), "split")
)
query("ml_confusion", on(FEATURES + _GUESS, "SELECT is_churned, CAST(prediction AS DOUBLE) AS prediction, count(*) AS n FROM gu GROUP BY 1, 2"))(
    lambda s: cm.ml_confusion(guesses(s))
)
_C = "count(CASE WHEN is_churned = {0} AND prediction = {1} THEN 1 END)"
_TP, _FP, _FN, _TN = _C.format(1, 1), _C.format(0, 1), _C.format(1, 0), _C.format(0, 0)
_P, _R = f"CAST({_TP} AS DOUBLE) / ({_TP} + {_FP})", f"CAST({_TP} AS DOUBLE) / ({_TP} + {_FN})"
query("ml_test_metrics", on(FEATURES + _GUESS, f"""SELECT CAST({_TP} + {_TN} AS DOUBLE) / count(*) AS accuracy, {_P} AS precision, {_R} AS recall,
  2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) AS f1 FROM gu"""))(lambda s: cm.ml_test_metrics(guesses(s)))
query("ml_class_report", on(FEATURES + _GUESS, """, k AS (SELECT unnest([0, 1]) AS class),
  r AS (SELECT class, count(CASE WHEN is_churned = class AND prediction = class THEN 1 END) AS hit,
    count(CASE WHEN prediction = class THEN 1 END) AS guessed, count(CASE WHEN is_churned = class THEN 1 END) AS support
    FROM gu CROSS JOIN k GROUP BY 1),
  q AS (SELECT class, CAST(hit AS DOUBLE) / guessed AS precision, CAST(hit AS DOUBLE) / support AS recall, support FROM r)
  SELECT CAST(class AS BIGINT) AS class, precision, recall, 2 * precision * recall / (precision + recall) AS f1, support FROM q""".lstrip()))(
    lambda s: cm.ml_class_report(guesses(s))
)
_ROC = _GUESS + """, ps AS (SELECT score, count(CASE WHEN is_churned = 1 THEN 1 END) AS pos, count(CASE WHEN is_churned = 0 THEN 1 END) AS neg
    FROM gu GROUP BY 1),
  rc AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM ps)"""
query("ml_roc", on(FEATURES + _ROC, """SELECT score, CAST(fp AS DOUBLE) / (SELECT sum(neg) FROM ps) AS fpr,
  CAST(tp AS DOUBLE) / (SELECT sum(pos) FROM ps) AS tpr FROM rc"""))(
    lambda s: cm.ml_roc(guesses(s)).select("score", "fpr", "tpr")
)
query("ml_roc_auc", on(FEATURES + _ROC, """SELECT round(sum(neg * (tp - pos / CAST(2 AS DOUBLE)))
  / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 9) AS roc_auc FROM rc"""))(
    lambda s: cm.roc_auc(cm.ml_roc(guesses(s))).select(F.round("roc_auc", 9).alias("roc_auc"))
)


def split_sides(s):
    df, names = table(s)
    dealt = written(cm.ml_split(df), "split")
    return dealt.filter(F.col("split") == "train"), dealt.filter(F.col("split") == "test"), names


@query("ml_smote", on(FEATURES + _SPLIT, """, c AS (SELECT is_churned, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1)
  SELECT is_churned, (SELECT max(n) FROM c) AS rows, (SELECT max(n) FROM c) - n AS synthetic FROM c""".lstrip()))
def _(s):
    """Class sizes after oversampling; where the new rows lie is checked in the tests."""
    train, _, names = split_sides(s)
    return cm.ml_smote(train, names).groupBy("is_churned").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("synthetic").alias("synthetic")
    )


def _scored(kind):
    def run(s):
        train, test, names = split_sides(s)
        learner = next(m for m in cm.learners(TREES) if m.kind == kind)
        return cm.predict(cm.fit_learner(learner, train, names), test).select(
            PERSON, "is_churned", F.round("score", 6).alias("score"), "prediction"
        )

    return run


for _key, _kind in (("ml_logreg", "logistic"), ("ml_forest", "forest"), ("ml_boost", "boost")):
    query(_key)(_scored(_kind))


@query("ml_importance")
def _(s):
    train, _, names = split_sides(s)
    model = cm.fit_learner(cm.learners(TREES)[1], train, names)
    return cm.ml_importance(model, names, train, 15)


@query("ml_cv")
def _(s):
    train, _, names = split_sides(s)
    return cm.ml_cv(train, names, cm.learners(TREES))


_DEALT = _GUESS + f""", fo AS (SELECT gu.*, (row_number() OVER (PARTITION BY is_churned ORDER BY {_UNIT('fold42:')}, customer_unique_id) - 1) % 5 AS fold FROM gu),
  mo AS (SELECT unnest(['as scored', 'turned round']) AS model),
  pr AS (SELECT model, fold, is_churned, CASE WHEN model = 'as scored' THEN score ELSE round(1 - score, 3) END AS score FROM fo CROSS JOIN mo),
  ct AS (SELECT model, fold, score, count(CASE WHEN is_churned = 1 THEN 1 END) AS pos, count(CASE WHEN is_churned = 0 THEN 1 END) AS neg FROM pr GROUP BY 1, 2, 3),
  rt AS (SELECT *, sum(pos) OVER (PARTITION BY model, fold ORDER BY score DESC) AS seen FROM ct),
  me AS (SELECT model, fold, CAST(sum(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN score >= 0.5 THEN neg ELSE 0 END) AS DOUBLE) AS fp,
    CAST(sum(CASE WHEN score < 0.5 THEN pos ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN score < 0.5 THEN neg ELSE 0 END) AS DOUBLE) AS tn,
    sum(neg * (seen - pos / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc FROM rt GROUP BY 1, 2)"""


@query("ml_cv_metrics", on(FEATURES + _DEALT, """SELECT model, fold, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(roc_auc, 9) AS roc_auc FROM me"""))
def _(s):
    """The metrics of every model and fold from stored predictions, two sets of scores made from keys."""
    dealt = cm.ml_folds(guesses(s).drop("prediction"))
    turned = dealt.withColumn("score", F.round(1 - F.col("score"), 3)).withColumn("model", F.lit("turned round"))
    both = dealt.withColumn("model", F.lit("as scored")).unionByName(turned)
    stored = written(both.withColumn("prediction", (F.col("score") >= 0.5).cast("double")), "predictions")
    return cm.all_metrics(stored, ["model", "fold"]).select("model", "fold", *[F.round(x, 9).alias(x) for x in cm.METRICS])


def compared(s):
    train, test, names = split_sides(s)
    models = cm.learners(TREES)
    target = inheritable_thread_target(s.spark)
    with ThreadPool(len(models)) as pool:  # beside the folds: a fit's jobs are too short to keep all cores busy
        testing = pool.map_async(target(lambda m: (m.name, cm.evaluate(cm.predict(cm.fit_learner(m, train, names), test)))), models, chunksize=1)
        cv = cm.ml_cv(train, names, models)
        tests = dict(testing.get())
    return cm.ml_comparison(cv, tests)


query("ml_comparison")(compared)
query("ml_select_best")(lambda s: cm.ml_select_best(compared(s)).select("model", "test_auc_roc"))


@query("ml_save_model", on(FEATURES + _SPLIT, f"""SELECT customer_unique_id,
  CASE WHEN customer_unique_id % 3 = 0 THEN (SELECT max(main_category) + 1 FROM ml) ELSE main_category END AS main_category,
  main_payment_type, {len(_NAMES)} AS features, 1 AS same_score FROM sp WHERE split = 'test'"""))
def _(s):
    """A saved model scores raw rows it has not seen, a third of them with a label that was not there."""
    raw = labelled(s)
    df, names = cm.ml_table(raw)
    split = written(cm.ml_split(written(df, "ml-table")), "split")
    fit = cm.fit_learner(cm.learners()[0], split.filter(F.col("split") == "train"), names)
    model, path = cm.with_coders(fit, raw, names), scratch_path(s.spark, "model")
    cm.ml_save_model(model, path)
    loaded = cm.ml_load_model(path)
    label = F.when(F.col(PERSON) % 3 == 0, F.lit("not seen before")).otherwise(F.col("main_category"))
    fresh = raw.join(split.filter(F.col("split") == "test").select(PERSON), PERSON, "left_semi").drop("is_churned").withColumn("main_category", label)
    before = cm.predict(model, fresh).select(PERSON, F.col("score").alias("before"))
    after = loaded.transform(fresh).select(PERSON, *_TEXTS, vector_to_array("probability").getItem(1).alias("score"))
    return after.join(before, PERSON).select(
        PERSON, *_TEXTS, F.lit(len(cm.model_features(loaded))).alias("features"), (F.abs(F.col("score") - F.col("before")) < 1e-12).alias("same_score")
    )
