"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once unmeasured, to compile its stages, then BENCH_RUNS times (default 3);
the fastest run counts.  Results go to the no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tablescout.plans import catalog

HEADLINE = [
    "quick_top_all_dimensions",
    "quick_top_dates",
    "quick_num",
    "profile_base_wide",
    "profile_orders",
    "value_distribution_texts",
    "value_distribution_numbers",
    "bin_distribution",
    "histogram",
    "iqr_outliers",
    "duplicate_rows_all_columns",
    "duplicate_keys",
    "pattern_scan",
    "dataset_report_orders",
    "chart_sum",
    "chart_stacked",
    "chart_histogram",
    "combined_filter",
    "where_range_text",
    "drill_bin",
    "grid_page",
    "grid_page_deep",
    "pivot_sum",
    "pivot_two_measures",
    "pivot_many_groups",
    "cell_formats",
    "generate_rows",
    "export_roundtrip",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablescout-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries = catalog.queries()
    seconds = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:] or times), 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
