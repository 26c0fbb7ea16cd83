"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from sampleworks.plans import registry

HEADLINE = (
    "joined_metrics", "joined_collected", "facet_histogram", "facet_categorical", "calc_rank", "calc_standardize", "calc_cumulative_sum", "summary_numeric", "group_by_field_tail",
    "iou_pairs", "greedy_match", "confusion", "average_precision", "threshold_sweep", "compare_outcomes", "sample_dynamics", "image_learning", "log_current_state", "knn_topk", "uniqueness", "preflight",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"file://{scratch}/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("joined_metrics")  # start the executors and compile
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
