"""The respondent views hit every code, bin and fallback they are meant to hit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelwise.fixtures.respondents import VIEWS, respondent_views, view_sql
from panelwise.functions.codes import AGE_BINS, GENDERS, OTHER_AGE, OTHER_GENDER
from panelwise.functions.flags import bins, decode
from panelwise.operators.joins import duplicate_keys

DIR = "/root/testdata/sf0.01"
CODES = {
    "diq010": {1, 2, 3, 7, 9, None},
    "bpq020": {1, 2, 7, 9, None},
    "bpq080": {1, 2, 7, 9, None},
    "hiq011": {1, 2, 7, 9, None},
    "huq010": {1, 2, 3, 4, 5, 7, 9, None},
    "huq030": {1, 2, 3, 7, 9},
    "huq042": {1, 2, 3, 4, 5, None},
    "huq055": {1, 2, 9, None},
    "huq090": {1, 2, 7},
    "rxq033": {1, 2, 7, 9},
    "whq070": {1, 2, 7, 9, None},
    "drqsdiet": {1, 2, 9, None},
    "riagendr": {1, 2, None},
    "ridreth3": {1, 2, 3, 4, 6},
}


@pytest.fixture(scope="module")
def tables(spark):
    return respondent_views(spark, DIR)


@pytest.mark.parametrize("view", VIEWS)
def test_every_code_occurs(view, tables):
    for column in VIEWS[view][1]:
        if column in CODES:
            found = {r[0] for r in tables[view].select(column).distinct().collect()}
            assert found == CODES[column], column


@pytest.mark.parametrize("view", VIEWS)
def test_key_is_unique(view, tables):
    assert duplicate_keys(tables[view], "seqn").isEmpty()


@pytest.mark.parametrize("view", [v for v in VIEWS if v != "demographics"])
def test_some_respondents_are_absent(view, tables):
    base = tables["demographics"]
    assert base.count() == 15000
    assert not base.join(tables[view], "seqn", "left_anti").isEmpty()


def test_every_bin_and_fallback_occurs(tables):
    people = tables["demographics"].select(
        bins(F.col("ridageyr"), AGE_BINS, OTHER_AGE).alias("a"),
        decode(F.col("riagendr"), GENDERS, OTHER_GENDER).alias("g"),
        (F.col("ridageyr") > 80).alias("old"),
    )
    assert {r[0] for r in people.select("a").distinct().collect()} == {
        *[label for _, _, label in AGE_BINS], OTHER_AGE
    }
    assert {r[0] for r in people.select("g").distinct().collect()} == {"Male", "Female", "0"}
    assert people.filter("old").count() == 320
    gap = tables["body_measures"].filter("bmxbmi > 29.9 AND bmxbmi < 30")
    assert not gap.isEmpty()


def test_views_are_the_same_rows_in_sql(tables):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{DIR}/orders.parquet')")
    for name, df in tables.items():
        want = con.sql(view_sql(name))
        assert want.columns == df.columns
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


def test_the_key_that_views_call_unique_is(spark, sf_dir):
    """The views mark their key as checked; here it is, for the table they all derive from."""
    from panelwise.operators.joins import assert_unique_key, known_unique

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert_unique_key(orders.where("o_orderkey IS NOT NULL"), "o_orderkey")
    for view in respondent_views(spark, sf_dir).values():
        assert known_unique(view, "seqn")
        assert_unique_key(view, "seqn")
