"""Compare ways to lay out and to phrase the same studies; prints one JSON line.

Joins are sort-merge joins here, as they are when no table is small enough to
broadcast. `plain` reads Parquet tables, `bucketed` the same tables bucketed
by the key, `unchecked` forgets that the key was checked, `branch_union` is the access
study as a union of one filtered branch per condition. With BENCH_COPIES each
order stands for that many respondents with keys of their own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from bench import CPUS, RUNS, SF_DIR, seconds  # noqa: E402
from panelwise.fixtures.respondents import respondent_views  # noqa: E402
from panelwise.functions.measures import aggregate, percent  # noqa: E402
from panelwise.plans.cohort import build_cohort  # noqa: E402
from panelwise.plans.studies import (  # noqa: E402
    ALL_RESPONDENTS,
    CARE_ANSWERS,
    CONDITION_ANSWERS,
    COVERAGE_ANSWER,
    STUDIES,
    care_measures,
    condition_groups,
    had_counseling,
    health_score,
    insurance_status,
)
from panelwise.session import prepare  # noqa: E402
from panelwise.sources.load import open_tables, replace_bucketed, replace_table  # noqa: E402


COPIES = int(os.environ.get("BENCH_COPIES", "1"))
PARTITIONS = os.environ.get("BENCH_PARTITIONS", CPUS)


def multiplied(spark, home: str) -> str:
    """The folder of a new `orders` table with COPIES rows for each order."""
    (
        spark.read.parquet(f"{SF_DIR}/orders.parquet")
        .repartition(int(CPUS))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        .select((F.col("o_orderkey") * COPIES + F.col("copy")).alias("o_orderkey"), "o_custkey")
        .write.parquet(f"{home}/orders.parquet")
    )
    return home


def branch_union(tables):
    cohort = build_cohort(tables, CONDITION_ANSWERS | COVERAGE_ANSWER | CARE_ANSWERS)
    cohort = cohort.withColumn("insurance_status", insurance_status())
    groups = {ALL_RESPONDENTS: F.lit(True), **condition_groups()}
    branches = [
        cohort.filter(test).withColumn("condition", F.lit(label))
        for label, test in groups.items()
    ]
    rows = branches[0]
    for branch in branches[1:]:
        rows = rows.unionByName(branch)
    measures = [
        *care_measures(), percent("pct_mental_counseling", had_counseling()), health_score()
    ]
    return aggregate(rows, ["condition", "insurance_status"], measures)


def main() -> None:
    home = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = prepare(
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", PARTITIONS)
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    views = respondent_views(spark, SF_DIR if COPIES == 1 else multiplied(spark, home))
    for name, df in views.items():
        replace_table(df, f"{home}/{name}")
        replace_bucketed(df, name, "seqn", int(PARTITIONS))
    plain = open_tables(spark, home, list(views))
    bucketed = {name: spark.table(name) for name in views}
    unchecked = {name: df.withMetadata("seqn", {}) for name, df in plain.items()}

    def timed(build) -> float:
        if COPIES == 1:
            build().collect()
        return round(statistics.median(seconds(lambda: build().collect()) for _ in range(RUNS)), 3)

    report = {
        name: {
            "plain": timed(lambda s=study: s(plain)),
            "bucketed": timed(lambda s=study: s(bucketed)),
            "unchecked": timed(lambda s=study: s(unchecked)),
        }
        for name, study in STUDIES.items() if name != "q1_overview"
    }
    report["q3_access_by_coverage"]["branch_union"] = timed(lambda: branch_union(plain))
    report["q1_overview"] = {"plain": timed(lambda: STUDIES["q1_overview"](plain))}
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
