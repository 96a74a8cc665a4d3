"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from parimart.plans import QUERIES
from parimart.session import configure

HEADLINE = [
    "C6_asof_devig", "C5_prior_history", "B12_dedupe_latest", "D4_mad_z", "E2_overround_entropy", "F2_top_combos", "G1_settle_bets", "G10_freeze_curve",
    "H5_curve_features", "H6_going_features", "H8_trailing_rates", "I4_horse_card", "J2_trio", "J5_gamma_walkforward", "K2_roi_report", "K4_calibration_quality", "K20_blend_grid", "N3_share_feed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    QUERIES["F10_distinct"](spark, sf_dir).count()  # the first query also starts the executors
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
