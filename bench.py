"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "labelled_windows", "hourly_pivot", "period_resample", "rolling_month", "rolling_given_dates",
    "second_source_windows", "earliest_positive", "onset_labels_grid", "demographics_at_date",
    "impute_window_mean", "combine_3d", "split_by_patient", "oversample_auto", "prep_train", "ts_basic",
    "feature_ranksum", "code_search_patterns", "code_pair_cooccurrence", "most_common", "topn_per_category",
    "eval_report", "eval_auc_scores",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one scan before the clock starts, so the first query does not pay for the JVM
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_linenumber").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
