"""Headline queries at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sightline.session import configure  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "evaluate_all_dives", "evaluate_val", "fitted_lines", "label_outliers", "failure_axes",
    "per_dive_metrics", "residual_stats", "balanced_epoch", "merged_predictions", "prior_sweep",
    "training_records", "dive_splits", "tile_grid", "leave_one_out_median", "confidence_by_outcome",
    "blobs", "classical_predictions", "size_audit", "clustered_tags",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR", "/tmp/sightline-bench"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first: class loading is not part of any figure.
    QUERIES["frame_counters"].run(spark, sf).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
