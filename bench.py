"""Time the studies on the sample tables; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query is run once
to warm up (reported as `cold`), then timed; `queries` holds the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalogue.queries import QUERIES  # noqa: E402
from panelwise.plans.studies import STUDIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [*STUDIES, "op_left_join", "op_unique_key_check", "op_xport_roundtrip"]
    cold, warm = {}, {}
    for name in names:
        # collect, not a noop write: reports are small and the order counts.
        # Row-level results go to a sink that discards them on the executors.
        def run(name=name):
            df = QUERIES[name](spark, SF_DIR)
            if name in STUDIES:
                df.collect()
            else:
                df.write.format("noop").mode("overwrite").save()

        cold[name] = round(seconds(run), 3)
        warm[name] = round(statistics.median(seconds(run) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds, warm median per query",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": SF_DIR.rstrip("/").rsplit("/sf", 1)[-1],
        "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
