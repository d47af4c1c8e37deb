"""Benchmark: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion into Spark's ``noop`` sink (full execution,
nothing collected to the driver); the time is wall-clock seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "site_ranking", "gw_index_rows", "sw_index_rows", "clean_readings", "yearly_trend", "class_counts",
    "wqi_histogram", "wqi_kde", "param_moments", "box_stats", "corr_matrix", "exceedance_rates",
    "water_type_summary", "site_coords_match", "people_scores", "alert_outbox", "top_symptoms",
    "survey_totals", "ml_frame", "exact_split", "stratified_split", "kfold_assign", "noise_augment",
    "eval_class_metrics", "eval_regression_metrics", "knn_classify", "knn_impute", "smote_synthetic",
    "stream_alerts", "stream_daily_means",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from hydrosift.plans.registry import QUERIES
    from hydrosift.session import get_session
    spark = get_session("hydrosift-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g",
                               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-", dir="/tmp")})
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or HEADLINE
    # warm-up: JVM class loading and codegen caches, not timed
    QUERIES["class_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
