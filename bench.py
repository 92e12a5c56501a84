"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names; "all" times every registered query
"""

from __future__ import annotations

import json
import os
import sys
import time

from quillframe.session import build_session, remove_tables, scratch_tables
from workload import QUERIES

HEADLINE = (
    "group_aggregate", "group_aggregate_median", "kpis", "cohort_retention", "funnel", "segment", "contribution",
    "profile_dataset", "summary_stats", "quality_score", "value_counts", "correlation_matrix", "deep_correlation",
    "outlier_summary", "anomaly_report", "impute", "outlier_clip", "deduplicate_subset", "engineer_features", "trend",
    "decompose_by_key", "ewma", "running_total", "chart_histogram", "chart_violin", "detect_intent", "knn_cosine",
    "rate_limit", "usage_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else [n for n in HEADLINE if n in QUERIES]
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="20g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["segment"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the session
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        remove_tables(spark, scratch_tables())
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
