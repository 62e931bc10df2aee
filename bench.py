"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_RUNS the timed runs per query (the
median counts). One untimed run of each query warms up the session; results go to a sink that keeps nothing.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartlens.plans import catalog
from cartlens.session import build_session

HEADLINE = (
    "orders_clean", "clean_quality", "clean_funnel",
    "feat_transaction", "feat_category", "feat_payment_fanout", "user_features", "user_features_frame",
    "rfm_ntile", "rfm_distribution", "purchase_intervals_frame", "churn_labels", "churn_by_order_group",
    "kpi_monthly", "kpi_category_top20", "kpi_repeat_rate", "kpi_payment_share", "kpi_monthly_repeat",
    "kpi_monthly_margin", "kpi_state", "kpi_payment",
    "review_logistics", "review_category_rate", "review_chi2", "review_mwu", "keyword_compare",
    "eda_describe", "hash_label", "psm_match",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    with contextlib.redirect_stdout(sys.stderr):
        for name in names:
            once(name)
            took[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline query seconds, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
