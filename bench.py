"""Wall-clock of the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One untimed flagship run warms the JVM; each query is then run once, from the input tables to all its rows.
"""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from emberline.plans.registry import QUERIES

HEADLINE = (
    "e1_fetch_fires",
    "w1_w2_fire_points",
    "j2_assign_region",
    "j4_raster_sample",
    "j8_weather",
    "j9_j10_a10_veg_index",
    "n7_n8_n10_synthetic_points",
    "e2_build_environment",
    "j13_e3_merge_features",
    "e6_audit",
    "a14_describe",
    "a15_value_shares",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberline-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("e1_fetch_fires")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else None,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
