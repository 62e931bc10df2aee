"""The job: steps clean, feature, churn, model, causal, review, business over stored tables.

Each step reads tables, writes new ones and never writes over what it reads. A step run alone takes
the tables of the steps before it from the output folder.

A step's outputs count once its row in ``<out>/_steps`` says done: the row says waiting before the step writes and is
written anew when all of its outputs are there. A resumed run skips the finished steps at the front that ran with the
same settings and source, and runs everything from the first unfinished one on.
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cartlens.config import FRAME, SQL, Thresholds, check_dialect
from cartlens.operators import churn, churn_model, clean, effect, features, keywords, kpi, matching, recode, reviews, rfm
from cartlens.operators.features import PERSON
from cartlens.session import build_session, written
from cartlens.schema import SCHEMAS
from cartlens.sources import tables
from cartlens.sources.adapter import CUTOFF, StarSource

log = logging.getLogger("cartlens")

# comment texts may hold line breaks, which keeps a file of them in one piece
_MULTILINE = {"order_reviews"}

_STEP_ROW = "step string, state string, settings string"


class FolderSource:
    """The nine tables as ``<folder>/<table>`` Parquet or ``<folder>/<table>.csv``."""

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind

    def table(self, name: str) -> DataFrame:
        if self.kind == "csv":
            return tables.read_csv(
                self.spark, f"{self.folder}/{name}.csv", SCHEMAS[name], multiline=name in _MULTILINE
            )
        return self.spark.read.parquet(f"{self.folder}/{name}")


def open_source(spark: SparkSession, folder: str, kind: str):
    return StarSource(spark, folder) if kind == "star" else FolderSource(spark, folder, kind)


class Job:
    STEPS = ("clean", "feature", "churn", "model", "causal", "review", "business")

    def __init__(
        self, spark: SparkSession, source, out: str, settings: Thresholds = Thresholds(), dialect: str = SQL,
        trees: int = 200, steps: tuple[str, ...] = STEPS,
    ):
        self.spark, self.source, self.out = spark, source, out.rstrip("/")
        self.cfg, self.dialect, self.trees = settings, check_dialect(dialect), trees
        if unknown := set(steps) - set(self.STEPS):
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        self.steps = tuple(n for n in self.STEPS if n in steps)

    def stored(self, name: str) -> DataFrame:
        return tables.read_parquet(self.spark, f"{self.out}/{name}")

    def store(self, name: str, df: DataFrame) -> DataFrame:
        tables.write_parquet(df, f"{self.out}/{name}")
        return self.stored(name)

    def report(self, name: str, df: DataFrame) -> None:
        tables.write_csv(df, f"{self.out}/reports/{name}")

    def _settings(self) -> str:
        cfg = self.cfg.with_(margin_rates=dict(sorted(self.cfg.margin_rates.items())))
        return f"{type(self.source).__name__} {self.source.folder} {self.dialect} {self.trees} {cfg}"

    def _mark(self, step: str, state: str) -> None:
        row = self.spark.createDataFrame([(step, state, self._settings())], _STEP_ROW)
        tables.write_json(row.coalesce(1), f"{self.out}/_steps/{step}")

    def finished(self, step: str) -> bool:
        """All outputs of the step are there, made with these settings from this source."""
        try:
            rows = self.spark.read.schema(_STEP_ROW).json(f"{self.out}/_steps/{step}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return [(r["state"], r["settings"]) for r in rows] == [("done", self._settings())]

    def run(self, step: str = "all", resume: bool = False) -> list[str]:
        """Runs one step or all of them; gives the names of those that ran."""
        begin, names = time.time(), list(self.steps) if step == "all" else [step]
        while resume and names and self.finished(names[0]):
            log.info("step %s: done before", names.pop(0))
        # later outputs rest on the earlier ones, so none of them counts any more
        rest = self.STEPS[self.STEPS.index(names[0]):] if names and names[0] in self.STEPS else names
        for name in rest:
            if name in names or self.finished(name):
                self._mark(name, "waiting")
        for name in names:
            start = time.time()
            getattr(self, f"step_{name}")()
            self._mark(name, "done")
            log.info("step %s: %.1f s", name, time.time() - start)
        log.info("done: %.1f s", time.time() - begin)
        return names

    def step_conform(self) -> None:
        known = {n: self.source.table(n) for n in SCHEMAS}
        for name, df in recode.conform_all(known).items():
            tables.write_parquet(df, f"{self.out}/conformed/{name}")

    def step_clean(self) -> None:
        orders, customers = self.source.table("orders"), self.source.table("customers")
        done = self.store("orders_clean", clean.orders_clean(orders, customers, self.dialect))
        self.report("clean_quality", clean.clean_quality(done))
        self.report("clean_funnel", clean.clean_funnel(orders, customers))

    def step_feature(self) -> None:
        t = self.source.table
        base = written(
            features.user_features(
                self.stored("orders_clean"), t("order_items"), t("order_payments"), t("order_reviews"), t("products"),
                self.cfg.cutoff_date, self.dialect, self.cfg.low_review_score, self.cfg.severe_delay_days,
            ),
            "features",
        )
        done = self.store("user_features", rfm.with_rfm(base, self.dialect, self.cfg.rfm_bins))
        self.report("features_summary", features.features_summary(done))
        self.report("missing_profile", features.missing_profile(done))
        self.report("rfm_distribution", rfm.rfm_distribution(done))

    def step_churn(self) -> None:
        cfg, people = self.cfg, self.stored("user_features")
        gaps = written(churn.interval_counts(self.stored("orders_clean"), self.dialect, cfg.min_orders), "intervals")
        rule = churn.churn_threshold_sql if self.dialect == SQL else churn.churn_threshold
        labels = churn.churn_labels(people, rule(gaps, cfg.churn_percentile, cfg.churn_multiplier))
        labels = self.store("churn_labels", labels)
        self.store("user_features_labelled", churn.churn_writeback(people, labels))
        self.report("churn_summary", churn.churn_summary(labels))
        self.report("churn_by_order_group", churn.churn_by_order_group(labels))
        self.report("churn_single_vs_multi", churn.churn_single_vs_multi(labels, gaps, cfg.min_orders))

    def step_model(self) -> None:
        cfg, m = self.cfg, churn_model
        people = self.stored("user_features_labelled")
        table, names = m.ml_table(people)
        split = written(m.ml_split(table, cfg.test_size, cfg.seed), "split")
        train, test = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")
        models = m.learners(self.trees)
        neg, pos = m.class_counts(train)
        cv = m.ml_cv(train, names, models, cfg.cv_folds, cfg.seed, cfg.smote_enabled)
        learn = written(m.ml_smote(train, names, seed=cfg.seed), "learn") if cfg.smote_enabled else train
        fits = {x.name: m.fit_learner(x, learn, names, cfg.seed, neg / pos if pos else 1.0) for x in models}
        tests = {}
        for name, fit in fits.items():
            guessed = written(m.predict(fit, test), "predictions")
            tests[name] = m.evaluate(guessed)
            tag = name.lower().replace(" ", "_")
            self.report(f"confusion_{tag}", m.ml_confusion(guessed))
            self.report(f"class_report_{tag}", m.ml_class_report(guessed))
            self.report(f"roc_{tag}", m.ml_roc(guessed).select("score", "fpr", "tpr"))
            self.report(f"importance_{tag}", m.ml_importance(fit, names, train))
        compared = m.ml_comparison(cv, tests)
        self.report("model_comparison", compared)
        best = m.ml_select_best(compared).first()["model"]
        m.ml_save_model(m.with_coders(fits[best], people, names), f"{self.out}/models/best_churn_model")

    def step_causal(self) -> None:
        cfg, e = self.cfg, effect
        study = written(e.psm_prepare(self.stored("user_features")), "study")
        scored = written(e.psm_score(study), "scored")
        pairs, caliper, rate = matching.match_widened(
            scored, PERSON, caliper=cfg.caliper, wide=cfg.wide_caliper, least=cfg.min_match_rate, k=cfg.neighbours
        )
        matched = written(e.psm_matched(scored, pairs), "matched")
        cells = written(e.outcome_cells(matched), "cells")
        att = written(e.psm_att(cells), "att")
        parts = {
            "sample_size": e.psm_sample_size(study),
            "descriptive": e.psm_descriptive(study),
            "propensity_score": e.psm_positivity(scored),
            "matching": cells.select(
                F.lit(caliper).alias("caliper"), F.lit(rate).alias("match_rate"),
                (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).alias("matched_pairs"),
            ),
            "balance_check": e.psm_balance(scored, matched, limit=cfg.smd_threshold),
            "att": att,
            "confidence": e.bootstrap_interval(e.psm_bootstrap(cells, cfg.bootstrap_n, cfg.seed)),
            "sensitivity": e.psm_rosenbaum(cells),
            "roi": e.psm_roi(study, att),
        }
        tables.write_json(e.causal_document(parts), f"{self.out}/causal_results")
        self.report("psm_ps_hist", e.psm_ps_hist(scored))
        self.report("psm_delay_bins", e.psm_delay_bins(study))

    def step_review(self) -> None:
        t, low = self.source.table, self.cfg.low_review_score
        r = reviews
        rows = written(r.review_lines(t("order_reviews"), t("orders"), t("order_items"), low=low,
                                      extra=("review_comment_message",)), "review-rows")
        plain = rows.drop("review_comment_message")
        by_category = written(r.review_lines(
            t("order_reviews"), t("orders"), t("order_items"), ("product_category_name",), t("products"), low
        ), "review-categories")
        by_seller = r.review_lines(t("order_reviews"), t("orders"), t("order_items"), ("seller_id",), low=low)
        for name, df in {
            "review_group_counts": r.review_group_counts(rows),
            "review_logistics": r.review_logistics(plain),
            "review_category_rate": r.low_rate(by_category, "product_category_name"),
            "review_state_rate": r.review_state_rate(plain, t("customers")),
            "review_amount": r.review_amount(plain),
            "review_seller_top": r.review_seller_top(by_seller),
            "review_chi2": r.review_chi2(by_category),
            "review_mwu": r.review_mwu(plain),
            "review_score_dist": r.review_score_dist(plain, plain),
            "review_heatmap": r.review_heatmap(plain),
        }.items():
            self.report(name, df)
        counts = written(keywords.keyword_counts(keywords.review_tokens(rows)), "words")
        compared = written(keywords.keyword_compare(keywords.keyword_top(counts)), "keywords")
        self.report("review_keywords", compared.orderBy(F.desc("diff_ratio"), "word"))
        self.report("keyword_report", keywords.keyword_report(compared))

    def step_business(self) -> None:
        t, cfg = self.source.table, self.cfg
        lines = written(
            kpi.sales_lines(
                t("orders"), t("order_items"), t("products"), t("order_payments"), cfg.margin_rates,
                cfg.default_margin, fanout=self.dialect == FRAME,
            ),
            "sales-lines",
        )
        monthly, categories = kpi.kpi_monthly_margin(lines), kpi.kpi_category(lines)
        for name, df in {
            "monthly_kpi": monthly.drop("freight_revenue"),
            "category_performance": categories,
            "category_profit_top10": kpi.top_categories(categories, "gross_profit"),
            "state_performance": kpi.kpi_state(lines, t("customers")),
            "payment_analysis": kpi.kpi_payment(t("order_payments"), t("orders")),
            "kpi_headline": kpi.kpi_headline(monthly, categories),
            "kpi_report_months": kpi.kpi_report_months(monthly),
            "kpi_monthly": kpi.kpi_monthly(t("orders"), t("order_items")),
            "kpi_category_top20": kpi.kpi_category_top(t("orders"), t("order_items"), t("products")),
            "kpi_repeat_rate": kpi.kpi_repeat_rate(t("orders"), t("customers")),
            "kpi_payment_share": kpi.kpi_payment_share(t("order_payments"), t("orders")),
            "kpi_monthly_repeat": kpi.kpi_monthly_repeat(t("orders"), t("customers")),
        }.items():
            self.report(name, df)
        pays = kpi.installment_rows(t("order_payments"), t("orders"))
        self.report("installments_dist", kpi.kpi_installments_dist(pays))
        self.report("installments_monthly", kpi.kpi_installments_monthly(pays))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cartlens", description="Commerce analytics on Spark.")
    parser.add_argument("--step", default="all", choices=("all", "conform", *Job.STEPS))
    parser.add_argument("--source", required=True, help="folder with the input tables")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv", "star"))
    parser.add_argument("--out", required=True, help="folder for tables, reports and models")
    parser.add_argument("--dialect", default=SQL, choices=(SQL, FRAME))
    parser.add_argument("--cutoff", help="last day of the data, yyyy-mm-dd")
    parser.add_argument("--trees", type=int, default=200)
    parser.add_argument("--resume", action="store_true", help="skip the finished steps of an earlier run")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    cfg = Thresholds()
    if args.cutoff or args.format == "star":
        cfg = cfg.with_(cutoff_date=args.cutoff or CUTOFF)
    spark = build_session()
    try:
        job = Job(spark, open_source(spark, args.source, args.format), args.out, cfg, args.dialect, args.trees)
        job.run(args.step, args.resume)
    finally:
        spark.stop()
