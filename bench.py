"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from keyloom.plans import catalog

HEADLINE = ("filter_chain", "prefix_scan", "range_page", "page_walk", "delim_rollup", "rollup_depth2", "class_tally", "global_sort_rank", "sort_parts", "range_boundaries", "alphabet_cardinality", "gini_mass", "tsv_rows", "jsonl_rows", "latency_percentiles", "time_weighted_avg", "trajectory_bins", "lineage_roots", "diff_full_outer", "range_membership", "manifest_rows")


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
