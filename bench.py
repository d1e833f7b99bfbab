"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm the JVM and caches, then timed ``BENCH_RUNS``
times (median kept).  Results are forced with the ``noop`` sink so the full
plan executes without shipping rows to the driver.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "all_features",          # feature job: text/structure/attribute/emotion families, one projection
    "label_text_profile",    # step-0 slice: features + label + grouped averages
    "evaluate",              # threshold metrics + exact ROC AUC (prefix sums)
    "pr_curve",              # distinct-score prefix table
    "roc_curve",
    "lift_table",            # exact global rank of every row
    "threshold_sweep",       # 81-cell histogram
    "calibration_curve",
    "fold_metrics",          # per-fold ranking metrics
    "pairwise_corr",         # pairwise-complete correlation
    "correlation_drop",
    "scale_features",        # fitted scaler over lineitem
    "stratified_folds",      # per-class hash ranks
    "oversample",
    "feature_groups",
    "drop_invalid_posts",    # image-table anti join
    "train_folds",           # 5 MLlib fits + exact fold metrics
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE

    from postsignal.registry import all_queries
    from postsignal.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, memory=os.environ.get("BENCH_MEM", "16g"))
    qs = all_queries()
    times = {}
    for n in names:
        fn = qs[n].fn
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
