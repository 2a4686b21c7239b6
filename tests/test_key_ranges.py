"""Repeated keys by footer ranges, and joins that know how hot a table's keys can get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelwise.operators.joins import (
    HOTTEST,
    DuplicateKeyError,
    duplicate_keys,
    hottest_rows,
    mark_unique,
    may_be_hot,
    note_hottest,
    sketch_hottest,
    star_left_join,
)
from panelwise.operators.key_ranges import (
    assert_unique_stored,
    duplicate_stored_keys,
    key_ranges,
    shared_parts,
)
from panelwise.sources.store import FileStore


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("ranges", "shared"), [
    ([(0, 9), (10, 19), (20, 29)], [(None, None)] * 3),
    ([(0, 10), (10, 19), (20, 29)], [(None, 10), (10, None), (None, None)]),
    ([(0, 99), (10, 19), (20, 29)], [(None, 10), (99, None), (99, None)]),
    ([(5, 5), (5, 5)], [(None, 5), (5, None)]),
    ([(0, 9), (None, None)], [(2**63 - 1, None)] * 2),
    ([], []),
])
def test_parts_that_ranges_share(ranges, shared):
    got = shared_parts([("f", i, low, high) for i, (low, high) in enumerate(ranges)])
    assert [(up_to, down_from) for _, _, up_to, down_from in got] == shared


def test_every_key_in_two_ranges_is_shared():
    """Random ranges: a key that two groups may hold is in the shared part of both."""
    import random

    pick = random.Random(1)
    for _ in range(300):
        bounds = [sorted(pick.choices(range(20), k=2)) for _ in range(pick.randint(1, 6))]
        parts = shared_parts([("f", i, *b) for i, b in enumerate(bounds)])
        for _, i, up_to, down_from in parts:
            for k in range(bounds[i][0], bounds[i][1] + 1):
                elsewhere = any(a <= k <= b for j, (a, b) in enumerate(bounds) if j != i)
                if elsewhere:
                    assert (up_to is not None and k <= up_to) or (down_from is not None and k >= down_from)


def write(df, path, **options):
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def test_a_sorted_table_is_checked_without_an_exchange(spark, tmp_path):
    df = write(spark.range(0, 100_000, numPartitions=8).toDF("k").withColumn("v", F.col("k") * 2), str(tmp_path / "t"))
    found = duplicate_stored_keys(df, "k")
    assert "Exchange" not in executed(found) and found.count() == 0
    assert assert_unique_stored(df, "k") is df


def test_repeated_keys_inside_sorted_files_need_no_exchange(spark, tmp_path):
    df = write(spark.range(0, 8000, numPartitions=8).select((F.col("id") - F.col("id") % 2).alias("k")), str(tmp_path / "t"))
    found = duplicate_stored_keys(df, "k")
    assert "Exchange" not in executed(found)
    assert pairs(found) == pairs(duplicate_keys(df, "k"))
    with pytest.raises(DuplicateKeyError, match="2 rows"):
        assert_unique_stored(df, "k")


@pytest.mark.parametrize("rows_a_group", [10, 10_000])
@pytest.mark.parametrize("kind", ["bigint", "int", "smallint"])
def test_keys_equal_those_of_the_plain_check(spark, tmp_path, kind, rows_a_group):
    df = spark.range(0, 5000, numPartitions=5).select(
        F.expr(f"CAST(CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 WHEN id > 4000 THEN id - 3000 ELSE id END AS {kind})").alias("k"),
        F.lit("x").alias("v"),
    )
    stored = write(df, str(tmp_path / "t"), **{"parquet.block.row.count.limit": rows_a_group})
    assert pairs(duplicate_stored_keys(stored, "k")) == pairs(duplicate_keys(df, "k"))
    assert duplicate_stored_keys(stored, "k").dtypes == duplicate_keys(stored, "k").dtypes


def test_awkward_tables(spark, frame, tmp_path):
    empty = write(frame("k long", []), str(tmp_path / "empty"))
    nulls = write(frame("k long", [(None,), (None,)]), str(tmp_path / "nulls"))
    for df in (empty, nulls):
        assert duplicate_stored_keys(df, "k").collect() == []
    words = write(frame("k string", [("a",), ("a",), ("b",)]), str(tmp_path / "words"))
    assert pairs(duplicate_stored_keys(words, "k")) == [("a", 2)]
    with pytest.raises(DuplicateKeyError):
        assert_unique_stored(words, "k")
    extremes = frame("k long, n_rows int, path string", [(2**63 - 1, 1, "x"), (-(2**63), 1, "x"), (2**63 - 1, 1, "x")])
    stored = write(extremes, str(tmp_path / "extremes"))
    assert pairs(duplicate_stored_keys(stored, "k")) == [(2**63 - 1, 2)]


def test_ranges_come_from_footers(spark, tmp_path):
    df = write(spark.range(10, 30, numPartitions=2).toDF("k"), str(tmp_path / "t"))
    found = key_ranges(spark, df.inputFiles(), "k")
    assert sorted((r.low, r.high) for r in found.collect()) == [(10, 19), (20, 29)]


# Hot keys


def with_hot(spark, rows, every):
    k = F.when(F.col("id") % every == 0, F.lit(7)).otherwise(F.col("id"))
    return spark.range(rows, numPartitions=8).select(k.alias("k"), F.col("id").alias("v"))


def test_the_sketch_never_counts_too_few(spark, frame):
    for every in (2, 10, 1000):
        df = with_hot(spark, 60_000, every)
        true = df.groupBy("k").count().agg(F.max("count")).first()[0]
        noted = sketch_hottest(df, "k").schema["k"].metadata[HOTTEST]
        assert true <= noted <= true + 4
    nulls = frame("k long", [(None,)] * 50 + [(1,), (1,)])
    assert 2 <= sketch_hottest(nulls, "k").schema["k"].metadata[HOTTEST] <= 3
    assert sketch_hottest(frame("k long", []), "k").schema["k"].metadata[HOTTEST] == 0
    assert hottest_rows(None, 100) == 1 and hottest_rows([], 0) == 0


def test_the_load_notes_how_hot_keys_get(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    store.replace({"a": with_hot(spark, 9000, 3)}, "k")
    noted = store.open("a").schema["k"].metadata[HOTTEST]
    assert 3001 <= noted <= 3002  # key 7 has a row of its own, too
    assert may_be_hot(store.open("a"), "k", hot_rows=2000) and not may_be_hot(store.open("a"), "k")


def test_only_tables_with_a_hot_key_are_completed(spark):
    base = spark.range(0, 5000).select(F.col("id").alias("k"))
    table = with_hot(spark, 6000, 3)
    plain = pairs(base.join(table, "k", "left"))
    cold, hot = note_hottest(table, "k", 100), note_hottest(table, "k", 2_000_000)
    for noted, joins in ((cold, 1), (hot, 2), (table, 2), (mark_unique(table, "k"), 1)):
        joined = star_left_join(base, {"t": noted}, "k")
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == joins, plan
        assert pairs(joined) == plain


def test_a_hot_key_is_split_after_the_load_found_it(spark, tmp_path):
    knobs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    store = FileStore(spark, str(tmp_path))
    store.replace({"hot": with_hot(spark, 60_000, 3).withColumn("r", F.rand(1)), "flat": with_hot(spark, 60_000, 70_000)}, "k")
    tables = store.open_all(["hot", "flat"])
    base = spark.range(60_000).select(F.col("id").alias("k"), F.rand(2).alias("w"))
    for name, value in knobs.items():
        spark.conf.set(name, value)
    try:
        split = star_left_join(base, {"t": tables["hot"]}, "k", hot_rows=1000)
        assert "skew=true" in executed(split)
        whole = star_left_join(base, {"t": tables["flat"]}, "k", hot_rows=1000)
        plan = executed(whole).split("== Initial Plan ==")[0]
        assert plan.count("SortMergeJoin") == 1 and "skew=true" not in plan
    finally:
        for name in knobs:
            spark.conf.unset(name)
