"""Loaded tables under `spark.sql`: the checks of the studies run there as well."""

from __future__ import annotations

from collections import Counter

import pytest

from catalogue.oracle import ORACLE
from panelwise.fixtures.respondents import respondent_views
from panelwise.plans.studies import STUDIES
from panelwise.sources.load import register_tables


@pytest.mark.parametrize("name", STUDIES)
def test_study_equals_its_sql_in_spark(name, spark, sf_dir):
    register_tables({"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")})
    by_sql = spark.sql(ORACLE[name])
    by_study = STUDIES[name](respondent_views(spark, sf_dir))
    assert sorted(by_study.columns) == sorted(by_sql.columns)
    want = by_sql.select(*by_study.columns)
    assert Counter(map(tuple, by_study.collect())) == Counter(map(tuple, want.collect()))
