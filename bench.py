"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query runs once to warm up and once timed, both times
computing all rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402

HEADLINE = [
    "scan_csv_customer",
    "infer_types_orders",
    "impute_mean",
    "impute_mode",
    "remove_outliers_events",
    "remove_outliers_lineitem",
    "flag_outliers",
    "preprocess",
    "clean_group_profile",
    "describe_all_events",
    "describe_numeric_lineitem",
    "describe_long_documents",
    "sql_projection",
    "sql_filter",
    "sql_group_by",
    "sql_distinct",
    "sql_top_k",
    "sql_subquery",
    "sql_self_join",
    "sql_set_operations",
    "sql_window",
    "chart_sample",
    "bar_count",
    "bar_mean",
    "histogram_lineitem",
    "kde",
    "pie_share",
    "box_stats",
    "crosstab",
    "corr_pair",
    "line_series",
    "correlations",
    "distribution_orders",
    "group_profile_lineitem",
    "trend",
    "label_encode",
    "impute_median",
    "standard_scale",
    "one_hot",
    "assemble",
    "eval_classification",
    "eval_regression",
    "model_small_regressor",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            # Computes every row and column without storing them.
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(folder).name.removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
