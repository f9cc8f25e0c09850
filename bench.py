"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fieldloom.plans import queries as plans

#: Pooling, fusion, folds, models, metrics, bootstrap and sequences.
HEADLINE = ["a02_spatial_pool", "a05_joint_pool", "a08_sum_cube", "j01_labelled", "j03_late_fusion", "f02_manifest", "m01_ridge_metrics", "m03_ridge_years", "m08_inseason_curve", "a12_summary", "a16_macro_and_pooled", "m13_bootstrap", "w02_skill_curves", "w06_best_lag", "u05_source_audit", "v02_matched_cohorts"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    taken = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
