"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS (default 3)
set the input, the cores and the number of warm runs; each figure is the median of those.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from plumbline.catalog.registry import REGISTRY  # noqa: E402

HEADLINE = (
    "validate_lineitem", "dq_issues", "completeness", "domain_violations", "zscore_outliers",
    "issue_examples", "duplicate_rows", "profile_base", "profile_numeric",
    "profile_top_categories", "audit_orders", "attribute_metrics", "bias_violations",
    "impute_sensitive_mode", "fix_chain", "fix_dedup_first", "fix_outliers_median",
    "median_impute", "isolation_forest", "lof", "anomaly_consensus", "binarize_target",
    "label_encode", "audit_end_to_end", "validate_lines", "stream_counts", "drift_changes",
    "group_auc", "lattice_sets", "histogram_scores", "class_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the call site of every expression costs more than small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        query = REGISTRY[name][0]
        taken = []
        for run in range(runs + 1):
            started = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            if run or runs == 0:
                taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
