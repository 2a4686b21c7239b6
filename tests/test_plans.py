"""Physical plans: what is read, what is shuffled, what is reused."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from catalogue.queries import QUERIES
from panelwise.operators.joins import assert_unique_key, duplicate_keys, mark_unique, star_left_join
from panelwise.plans.studies import STUDIES
from panelwise.sources.load import open_tables, replace_bucketed, replace_table
from tests import survey as plain

# Joins of each study, and other shuffles it needs besides one per joined input.
JOINS = {
    "q2_prevalence": 4,
    "q3_access_by_coverage": 5,
    "q4_comorbidity": 4,
    "q5_high_value_cohorts": 3,
    "q6_medication_burden": 4,
    "q7_rx_by_comorbidity": 4,
}


def executed(df) -> str:
    """The plan as it was finally run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A survey in plain tables and in tables bucketed by the key."""
    home = str(tmp_path_factory.mktemp("tables"))
    survey = plain.random_survey(21, 200)
    spark.sql("CREATE DATABASE IF NOT EXISTS survey")
    for name, rows in survey.items():
        df = mark_unique(spark.createDataFrame(rows, plain.schema(name)), "seqn")
        replace_table(df, f"{home}/{name}")
        replace_bucketed(df, f"survey.{name}", "seqn", 4)
    bucketed = {name: spark.table(f"survey.{name}") for name in survey}
    return open_tables(spark, home, list(survey)), bucketed


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", JOINS)
def test_each_input_is_shuffled_once(name, stored, no_broadcast):
    plan = executed(STUDIES[name](stored[0]))
    joins = JOINS[name]
    assert len(re.findall(r"SortMergeJoin|ShuffledHashJoin", plan)) == joins
    assert len(re.findall(r" Exchange hashpartitioning\(seqn", plan)) == joins + 1
    assert len(re.findall(r"FileScan parquet", plan)) == joins + 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", JOINS)
def test_bucketed_inputs_are_neither_shuffled_nor_sorted(name, stored, no_broadcast):
    plan = executed(STUDIES[name](stored[1]))
    assert "Exchange hashpartitioning(seqn" not in plan
    assert "Sort [seqn" not in plan
    assert STUDIES[name](stored[1]).collect() == STUDIES[name](stored[0]).collect()


@pytest.mark.parametrize("name", STUDIES)
def test_studies_stay_in_the_jvm(name, stored):
    plan = executed(STUDIES[name](stored[0]))
    assert not re.search(r"Python|Pandas|Arrow", plan)
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_scan_reads_needed_columns_and_gets_the_filter(stored):
    df = STUDIES["q4_comorbidity"](stored[0])
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    columns = sorted(re.sub(r"#\d+L?", "", s) for s in scans)
    assert columns == [
        "seqn,bmxbmi", "seqn,bpq020,bpq080", "seqn,diq010",
        "seqn,huq010,huq030,huq042,huq055", "seqn,ridageyr",
    ]
    assert "GreaterThanOrEqual(ridageyr,18.0)" in plan


def test_drug_filter_reaches_the_scan_of_an_inner_join(stored, no_broadcast):
    plan = executed(STUDIES["q6_medication_burden"](stored[0]))
    assert "In(rxq033, [1.0,2.0])" in plan
    assert len(re.findall(r"Join .*Inner", plan)) == 1


def test_overall_row_reuses_the_grouped_shuffle(stored):
    plan = executed(STUDIES["q5_high_value_cohorts"](stored[0]))
    assert plan.count("ReusedExchange") == 1


def test_reports_of_one_cohort_read_it_once(spark, sf_dir):
    plan = executed(QUERIES["op_cte_reuse"](spark, sf_dir))
    assert plan.count("FileScan parquet") == 2
    assert plan.count("ReusedExchange") == 2


def test_overview_shuffles_only_its_own_rows(stored, no_broadcast):
    """Every large table meets the first keys in a broadcast before any shuffle."""
    df = STUDIES["q1_overview"](stored[0], 20)
    plan = executed(df)
    assert plan.count("LeftSemi") == 5
    assert plan.count("ReusedExchange") == 4
    assert len(re.findall(r"TakeOrderedAndProject\(limit=20", plan)) == 3


def test_prevalence_is_one_aggregation(stored):
    plan = executed(STUDIES["q2_prevalence"](stored[0]))
    assert "Union" not in plan
    assert len(re.findall(r"HashAggregate", plan)) == 2


def test_membership_expands_sums_not_rows(stored, no_broadcast):
    plan = executed(STUDIES["q3_access_by_coverage"](stored[0]))
    above, below = plan.split("Generate explode", 1)
    assert "HashAggregate" in below
    assert "Join" not in above


def test_key_check_of_a_bucketed_table_needs_no_shuffle(stored):
    assert_unique_key(stored[1]["demographics"], "seqn")
    assert "Exchange" not in executed(duplicate_keys(stored[1]["demographics"], "seqn"))


@pytest.mark.parametrize("hot_side", ["base", "table"])
def test_skewed_partition_is_split_at_run_time(hot_side, spark, no_broadcast):
    knobs = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in knobs.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(0, 60000, numPartitions=16).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
            F.rand(1).alias("v"),
        )
        flat = [spark.range(60000).select(F.col("id").alias("k"), F.rand(2).alias(n)) for n in ("a", "b")]
        if hot_side == "base":
            joined = star_left_join(hot, {n: mark_unique(df, "k") for n, df in enumerate(flat)}, "k")
        else:
            joined = star_left_join(flat[0], {"v": hot, "b": mark_unique(flat[1], "k")}, "k")
        assert "skew=true" in executed(joined)
        # Of the hot table all 60,000 rows meet a base key, and 20,000 base keys meet nothing.
        assert joined.count() == (60000 if hot_side == "base" else 80000)
    finally:
        for k in knobs:
            spark.conf.unset(k)
