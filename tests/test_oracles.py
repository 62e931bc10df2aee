"""Registered queries beside their DuckDB texts on the smallest tables; the others must give rows.

A spread over all areas by default; ALL_QUERIES=1 takes every query (tools/check_oracles.py does the same
at any scale).
"""

import os

import pytest

from check_oracles import compare, connect, rows_of
from cartlens.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
ALL = os.environ.get("ALL_QUERIES") == "1"
SOME = {
    "orders_clean_frame", "clean_quality", "clean_funnel", "user_features", "user_features_frame", "rfm_qcut",
    "rfm_segment", "segment_box", "churn_labels", "churn_single_vs_multi", "kpi_monthly", "kpi_category_top20",
    "kpi_payment_share", "kpi_monthly_margin_fanout", "kpi_state", "kpi_headline", "review_chi2", "review_mwu",
    "review_heatmap", "keyword_compare", "eda_describe", "recode_fallback", "hash_label", "score_template",
    "src_csv", "save_table", "psm_match", "psm_balance", "cluster_crosstab", "ml_roc_auc", "ml_smote",
    "review_chi2_p", "psm_bootstrap",
}
# long fits; exercised by test_models on small frames
SLOW = {"kmeans_elbow", "kmeans_silhouette", "ml_cv", "ml_comparison", "ml_select_best", "ml_boost", "ml_forest"}


def chosen(names):
    return sorted(n for n in names if ALL or n in SOME)


@pytest.fixture(scope="module")
def duck(data_dir):
    return connect(data_dir)


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", chosen(ORACLES))
def test_same_rows(name, spark, duck, data_dir):
    df = QUERIES[name](spark, data_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert compare(got, want) == ""


@pytest.mark.parametrize("name", chosen(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(name, spark, data_dir):
    assert QUERIES[name](spark, data_dir).count() > 0
