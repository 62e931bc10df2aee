"""Churn models: feature table, split, oversampling, three learners, cross-validation, evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Sequence

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.scalars import hash_unit, plain_ratio
from cartlens.operators.effect import label_codes
from cartlens.operators.features import PERSON
from cartlens.operators.neighbours import nearest_neighbours
from cartlens.operators.ordered import global_rank, running_totals
from cartlens.session import written

TARGET = "is_churned"
_LEFT_OUT = ("id", "customer_unique", "date", "segment", "label", "cluster", "group")
_TELL_LABEL = ("recency_days", "rfm_r_score", "customer_tenure_days", "purchase_frequency", "rfm_f_score")
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")
TASK_ROWS = 50_000  # a fit's jobs are many and short: no partition holds fewer rows than this if it can be helped


# --- feature table ---------------------------------------------------------------------------

def ml_feature_select(df: DataFrame, features: str = "reference") -> list[str]:
    """Columns to learn from, by name and type. ``no_leak`` also leaves out what the label is made of.

    Tenure equals recency for a person with one order, and frequency is a function of tenure.
    """
    kept = [
        c for c, kind in df.dtypes
        if c != TARGET and not kind.startswith(("timestamp", "date")) and not any(w in c.lower() for w in _LEFT_OUT)
    ]
    if features == "no_leak":
        kept = [c for c in kept if c not in _TELL_LABEL]
    return kept


def ml_label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to alphabetical codes from zero, a missing label counting as 'unknown'."""
    for c in columns:
        df = label_codes(df, c, missing="unknown").drop(c).withColumnRenamed(f"{c}_encoded", c)
    return df


def ml_table(df: DataFrame, features: str = "reference", key: str = PERSON) -> tuple[DataFrame, list[str]]:
    """Key, label and all-number features without gaps."""
    names = ml_feature_select(df, features)
    texts = [c for c, kind in df.select(*names).dtypes if kind == "string"]
    coded = ml_label_encode(df.select(key, TARGET, *names), texts)
    filled = coded.select(
        key, F.col(TARGET).cast("double").alias(TARGET),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
    )
    return filled, names


def ml_churn_share(df: DataFrame, by: str | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    measures = n.alias("rows"), plain_ratio(F.sum(TARGET), n).alias("churn_rate")
    return (df.groupBy(by) if by else df).agg(*measures)


def _dealt(df: DataFrame, key: str, salt: str) -> DataFrame:
    """A fixed shuffle within each class: place and class size, the same whatever the partitioning."""
    drawn = df.withColumn("_draw", hash_unit(F.col(key), salt))
    return global_rank(drawn, ["_draw", key], within=[TARGET], rank="_place", size="_class").drop("_draw")


def ml_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = PERSON) -> DataFrame:
    """Adds ``split``: exactly the rounded share of each class goes to the test side."""
    test = F.col("_place") <= F.round(F.col("_class") * F.lit(test_size))
    return _dealt(df, key, f"split{seed}:").withColumn("split", F.when(test, "test").otherwise("train")).drop(
        "_place", "_class"
    )


def ml_folds(df: DataFrame, folds: int = 5, seed: int = 42, key: str = PERSON) -> DataFrame:
    """Adds ``fold``: each class is dealt out in turn."""
    return _dealt(df, key, f"fold{seed}:").withColumn("fold", ((F.col("_place") - 1) % folds).cast("int")).drop(
        "_place", "_class"
    )


# --- oversampling ----------------------------------------------------------------------------

def ml_smote(
    train: DataFrame, names: Sequence[str], k: int = 5, seed: int = 42, key: str = PERSON, block_rows: int = 2048,
    friends: DataFrame | None = None,
) -> DataFrame:
    """The rows plus made-up ones of the smaller class until both classes are equal.

    Each new row lies between a drawn row and one of its ``k`` nearest in class. Drawn row, neighbour
    and position come from hashes of the new row's number. Columns ``synthetic``, ``parent_a`` and
    ``parent_b`` tell where a row comes from. ``friends`` (id, friends) gives neighbours found before.
    """
    counts = {r[TARGET]: r["count"] for r in train.groupBy(TARGET).count().collect()}
    own = train.select(key, TARGET, *names, F.lit(0).alias("synthetic"), *[
        F.lit(None).cast(dict(train.dtypes)[key]).alias(p) for p in ("parent_a", "parent_b")
    ])
    if len(counts) < 2:
        return own
    small, big = sorted(counts, key=lambda c: counts[c])
    missing, have = counts[big] - counts[small], counts[small]
    if missing == 0 or have < 2:
        return own
    minority = train.filter(F.col(TARGET) == small).select(key, *names)
    near = friends if friends is not None else nearest_neighbours(minority, key, names, k, block_rows).select("id", F.col("near.id").alias("friends"))
    parents = written(
        global_rank(minority.join(near, F.col(key) == F.col("id")).drop("id"), [key]).drop("group_size"), "smote-parents"
    )
    draw = lambda tag: F.xxhash64(F.lit(seed), F.lit(tag), F.col("n"))
    picks = train.sparkSession.range(missing).withColumnRenamed("id", "n").select(
        "n", (F.pmod(draw(1), F.lit(have)) + 1).alias("rank"), draw(2).alias("pick"),
        (F.pmod(draw(3), F.lit(1 << 30)) / float(1 << 30)).alias("u"),
    )
    based = picks.join(parents, "rank").select(
        "n", "u", F.col(key).alias("parent_a"),
        F.element_at("friends", (F.pmod(F.col("pick"), F.size("friends")) + 1).cast("int")).alias("parent_b"),
        *[F.col(c).alias(f"_a_{c}") for c in names],
    )
    other = minority.select(F.col(key).alias("parent_b"), *[F.col(c).alias(f"_b_{c}") for c in names])
    between = lambda c: F.col(f"_a_{c}") + F.col("u") * (F.col(f"_b_{c}") - F.col(f"_a_{c}"))
    made = based.join(other, "parent_b").select(
        F.lit(None).cast(dict(train.dtypes)[key]).alias(key), F.lit(small).alias(TARGET),
        *[between(c).alias(c) for c in names], F.lit(1).alias("synthetic"), "parent_a", "parent_b",
    )
    return own.unionByName(made)


def smaller_class(rows: DataFrame) -> float | None:
    """The label with fewer rows; None where there is one label, or both are equal."""
    counts = {r[TARGET]: r["count"] for r in rows.groupBy(TARGET).count().collect()}
    if len(counts) < 2 or len(set(counts.values())) == 1:
        return None
    return min(counts, key=lambda c: (counts[c], c))


def fold_friends(
    dealt: DataFrame, names: Sequence[str], folds: int, k: int = 5, margin: int = 9, key: str = PERSON, block_rows: int = 2048
) -> dict[int, DataFrame]:
    """(id, friends) of the smaller class for each fold's learning side, from one search over the whole class.

    The search keeps ``margin`` neighbours more than are needed; a fold drops those it holds out. Only points left
    with fewer than ``k`` (or than there are) are sought again, among that fold's learning rows. Folds whose smaller
    class differs from the whole's are left out.
    """
    small = smaller_class(dealt)
    if small is None:
        return {}
    minority = written(dealt.filter(F.col(TARGET) == small).select(key, "fold", *names), "cv-minority")
    found = nearest_neighbours(minority, key, names, k + margin, block_rows)
    at = minority.select(F.col(key).alias("id"), F.col("fold").alias("own_fold"))
    pairs = found.select("id", F.posexplode("near").alias("place", "near")).select("id", "place", F.col("near.id").alias("friend"))
    told = pairs.join(at.select(F.col("id").alias("friend"), F.col("own_fold").alias("fold")), "friend")
    lists = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "friend", "fold"))).alias("near"))
    lists = written(at.join(lists, "id", "left"), "cv-near")
    sizes = {(r["fold"], r[TARGET]): r["count"] for r in dealt.groupBy("fold", TARGET).count().collect()}
    out = {}
    for fold in range(folds):
        left = {c: sum(n for (f, l), n in sizes.items() if f != fold and l == c) for c in (0.0, 1.0)}
        if left[small] >= left[1.0 - small]:
            continue
        kept = F.slice(F.filter("near", lambda e: e["fold"] != fold), 1, k)
        own = written(lists.filter(F.col("own_fold") != fold).select("id", F.coalesce(kept["friend"], F.array()).alias("friends")), "cv-friends")
        few = own.filter(F.size("friends") < min(k, left[small] - 1))
        if not few.isEmpty():
            again = nearest_neighbours(minority.filter(F.col("fold") != fold), key, names, k, block_rows, askers=few)
            again = again.select("id", F.col("near.id").alias("friends"))
            own = written(own.join(few.select("id"), "id", "left_anti").unionByName(again), "cv-friends")
        out[fold] = own
    return out


# --- learners --------------------------------------------------------------------------------

@dataclass(frozen=True)
class Learner:
    name: str
    kind: str
    trees: int = 200

    def estimator(self, weight: str, rows: int, seed: int):
        common = dict(featuresCol="features", labelCol=TARGET, weightCol=weight)
        if self.kind == "logistic":
            return LogisticRegression(
                regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-4, **common
            )
        if self.kind == "forest":
            return RandomForestClassifier(numTrees=self.trees, maxDepth=10, seed=seed, **common)
        return GBTClassifier(maxIter=self.trees, maxDepth=6, stepSize=0.1, seed=seed, **common)


def learners(trees: int = 200) -> list[Learner]:
    """Logistic regression, random forest of depth 10, boosted trees of depth 6 and step 0.1."""
    return [
        Learner("Logistic Regression", "logistic"),
        Learner("Random Forest", "forest", trees),
        Learner("Boosted Trees", "boost", trees),
    ]


def class_counts(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.count_if(F.col(TARGET) == 0), F.count_if(F.col(TARGET) == 1)).first()
    return row[0], row[1]


def fit_learner(
    learner: Learner, train: DataFrame, names: Sequence[str], seed: int = 42, pos_weight: float | None = None
) -> PipelineModel:
    """Fits with balanced class weights; boosting weighs positives by ``pos_weight`` (negatives per positive)."""
    neg, pos = class_counts(train)
    n = neg + pos
    if learner.kind == "boost":
        up = pos_weight if pos_weight is not None else (neg / pos if pos else 1.0)
        weight = F.when(F.col(TARGET) == 1, float(up)).otherwise(1.0)
    else:
        weight = F.when(F.col(TARGET) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(neg, 1)))
    stages = [VectorAssembler(inputCols=list(names), outputCol="features"), learner.estimator("_w", n, seed)]
    rows = train.select(TARGET, *names).withColumn("_w", weight).coalesce(max(1, -(-n // TASK_ROWS)))
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, key: str = PERSON) -> DataFrame:
    """Key, label (where the rows have one), prediction and score."""
    known = [TARGET] if TARGET in rows.columns else []
    return model.transform(rows).select(
        key, *known, "prediction", vector_to_array("probability").getItem(1).alias("score")
    )


# --- evaluation ------------------------------------------------------------------------------

def ml_confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(TARGET, "prediction").agg(F.count(F.lit(1)).alias("n"))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def ml_test_metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; an empty denominator gives zero."""
    label, guess = F.col(TARGET) == 1, F.col("prediction") == 1
    c = predicted.agg(
        F.count_if(label & guess).alias("tp"), F.count_if(~label & guess).alias("fp"),
        F.count_if(label & ~guess).alias("fn"), F.count_if(~label & ~guess).alias("tn"),
    )
    safe = lambda a, b: F.coalesce(plain_ratio(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"), _f1(safe(tp, tp + fp), safe(tp, tp + fn)).alias("f1"),
    )


def ml_class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    pairs = predicted.groupBy(TARGET, "prediction").agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col(TARGET).cast("int").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                         F.when(F.col(TARGET) == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").cast("int").alias("class"), F.lit(0).cast("bigint").alias("support"),
                         F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    safe = lambda a, b: F.coalesce(plain_ratio(a, b), F.lit(0.0))
    p, r = safe(F.sum("hit"), F.sum("guessed")), safe(F.sum("hit"), F.sum("support"))
    return rows.groupBy("class").agg(
        p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.sum("support").alias("support")
    )


def ml_roc(predicted: DataFrame) -> DataFrame:
    """(score, fpr, tpr) per different score, from the highest; running totals over a global order."""
    per_score = predicted.groupBy("score").agg(
        F.count_if(F.col(TARGET) == 1).alias("pos"), F.count_if(F.col(TARGET) == 0).alias("neg")
    )
    curve = running_totals(per_score, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    total = curve.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return curve.select(
        "score", plain_ratio(F.col("fp"), total["n"]).alias("fpr"), plain_ratio(F.col("tp"), total["p"]).alias("tpr"),
        "pos", "neg", "tp", "fp",
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area by trapezoids: each negative counts the positives above it and half of those level with it."""
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    return curve.agg(plain_ratio(area, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def evaluate(predicted: DataFrame) -> dict[str, float]:
    """All metrics of one model's predictions."""
    row = all_metrics(predicted, []).first()
    return {m: float(row[m]) for m in METRICS}


def all_metrics(predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    """The five metrics per group of predictions, from counts per score: one aggregation and one global order.

    ``by`` names columns with a short list of values (model, fold). The area counts, for each negative, the positives
    above it and half of those level with it.
    """
    label, guess = F.col(TARGET) == 1, F.col("prediction") == 1
    counts = written(predicted.groupBy(*by, "score").agg(
        F.count_if(label & guess).alias("tp"), F.count_if(~label & guess).alias("fp"),
        F.count_if(label & ~guess).alias("fn"), F.count_if(~label & ~guess).alias("tn"),
    ).withColumns({"pos": F.col("tp") + F.col("fn"), "neg": F.col("fp") + F.col("tn")}), "score-counts")
    order = [*by, F.desc("score")]
    curve = running_totals(counts, order, {"seen": "pos"})
    # a group covers neighbouring scores in the order, so its first running total tells what lies before it
    area = (F.col("neg").cast("decimal(38,0)") * (2 * F.col("seen") - F.col("pos"))).alias("_twice")
    sums = curve.select("*", area).groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "pos", "neg")], F.sum("_twice").alias("_twice"),
        F.min(F.col("seen") - F.col("pos")).alias("_before"),
    )
    safe = lambda a, b: F.coalesce(plain_ratio(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    own = F.col("_twice") - 2 * F.col("_before") * F.col("neg").cast("decimal(38,0)")
    return sums.select(
        *by, safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"), _f1(safe(tp, tp + fp), safe(tp, tp + fn)).alias("f1"),
        plain_ratio(own.cast("double") / 2.0, F.col("pos").cast("double") * F.col("neg")).alias("roc_auc"),
    )


def cv_predictions(
    train: DataFrame, names: Sequence[str], models: Sequence[Learner], folds: int = 5, seed: int = 42,
    smote: bool = True, smote_inside: bool = True, key: str = PERSON, parallelism: int = 8,
) -> DataFrame:
    """model, fold, key, label, prediction, score of every held-out row, written once per fold and model.

    Oversampling happens inside the folds, on the learning side only; the neighbours for all folds come from one search.
    ``smote_inside=False`` does it before dealing the folds, which lets made-up rows near a held-out row into its
    training set. Fits of several folds and models run side by side, the last models, which take longest, first.
    """
    rows = train
    if smote and not smote_inside:
        made = ml_smote(train, names, seed=seed, key=key)
        number = F.coalesce(F.col(key).cast("string"), F.concat_ws(":", "parent_a", "parent_b", *names))
        rows = written(made.withColumn(key, number), "cv-rows")
    dealt = written(ml_folds(rows.select(key, TARGET, *names), folds, seed, key), "cv-folds")
    neg, pos = class_counts(train)
    friends = fold_friends(dealt, names, folds, key=key) if smote and smote_inside else {}

    def learning(fold: int) -> DataFrame:
        learn = dealt.filter(F.col("fold") != fold)
        if smote and smote_inside:
            learn = written(ml_smote(learn, names, seed=seed, key=key, friends=friends.get(fold)).select(TARGET, *names), "cv-learn")
        return learn

    def run(task: tuple[int, Learner, DataFrame]) -> DataFrame:
        fold, model, learn = task
        fit = fit_learner(model, learn, names, seed, neg / pos if pos else 1.0)
        scored = predict(fit, dealt.filter(F.col("fold") == fold), key)
        return written(scored.select(F.lit(model.name).alias("model"), F.lit(fold).alias("fold"), key, TARGET, "prediction", "score"), "cv-scores")

    target = inheritable_thread_target(train.sparkSession)
    with ThreadPool(parallelism) as pool:
        sides = pool.map(target(learning), range(folds))
        parts = pool.map(target(run), [(f, m, sides[f]) for m in reversed(models) for f in range(folds)], chunksize=1)
    return reduce(DataFrame.unionByName, parts)


def ml_cv(
    train: DataFrame, names: Sequence[str], models: Sequence[Learner], folds: int = 5, seed: int = 42,
    smote: bool = True, smote_inside: bool = True, key: str = PERSON, parallelism: int = 8,
) -> DataFrame:
    """All metrics per model and fold from one fit each and one pass over all predictions."""
    predictions = cv_predictions(train, names, models, folds, seed, smote, smote_inside, key, parallelism)
    return all_metrics(predictions, ["model", "fold"])


def ml_comparison(cv: DataFrame, tests: dict[str, dict[str, float]]) -> DataFrame:
    """One row per model: mean and population deviation over the folds beside the test metrics."""
    spark = cv.sparkSession
    stats = cv.groupBy("model").agg(
        *[c for m in METRICS for c in (F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std"))]
    )
    names = {"roc_auc": "auc_roc"}
    rows = [(model, *[float(s[m]) for m in METRICS]) for model, s in tests.items()]
    schema = "model string, " + ", ".join(f"test_{names.get(m, m)} double" for m in METRICS)
    return stats.join(F.broadcast(spark.createDataFrame(rows, schema)), "model")


def ml_select_best(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.desc("test_auc_roc"), "model").limit(1)


def ml_importance(model: PipelineModel, names: Sequence[str], like: DataFrame, top: int | None = None) -> DataFrame:
    """Absolute coefficients of the linear model, impurity importances of the others, largest first."""
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        values = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        values = [float(v) for v in last.featureImportances.toArray()]
    df = like.sparkSession.createDataFrame(list(zip(names, values)), "feature string, importance double")
    ordered = df.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered


def with_coders(model: PipelineModel, table: DataFrame, names: Sequence[str]) -> PipelineModel:
    """The model behind stages that make its inputs from a raw feature table, as ``ml_table`` does.

    Labels get their alphabetical codes in ``table``, a missing one counting as 'unknown' and one not seen there as the
    code after the last; gaps in numbers become zero. Codes and names are parts of the stages, so they are saved along.
    """
    kinds = dict(table.dtypes)
    texts = [c for c in names if kinds[c] == "string"]
    label = lambda c: f"coalesce(`{c}`, 'unknown') AS `{c}__label`"
    number = lambda c: f"coalesce(CAST(`{c}` AS DOUBLE), 0.0) AS `{c}`"
    parts = ", ".join(label(c) if c in texts else number(c) for c in names)
    left_out = ", ".join(f"`{c}`" for c in names)
    stages = [SQLTransformer(statement=f"SELECT * EXCEPT ({left_out}), {parts} FROM __THIS__")]
    if texts:
        coder = StringIndexer(
            inputCols=[f"{c}__label" for c in texts], outputCols=texts, stringOrderType="alphabetAsc", handleInvalid="keep"
        )
        stages.append(coder.fit(stages[0].transform(table)))
    return PipelineModel([*stages, *model.stages])


def model_features(model: PipelineModel) -> list[str]:
    return next(list(s.getInputCols()) for s in model.stages if isinstance(s, VectorAssembler))


def model_labels(model: PipelineModel) -> dict[str, list[str]]:
    """The labels of each text feature in the order of their codes."""
    found = [s for s in model.stages if isinstance(s, StringIndexerModel)]
    return {c: list(labels) for s in found for c, labels in zip(s.getOutputCols(), s.labelsArray)}


def ml_save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def ml_load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
