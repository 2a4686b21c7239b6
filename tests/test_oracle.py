"""Every query against its SQL check: names, types and values of all rows."""

from __future__ import annotations

from collections import Counter

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalogue.queries import QUERIES

TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",  # SQL's has no zone
}


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = queries()[name](spark, sf_dir)
    expected = duck.sql(oracle_sql()[name])
    types = {c: TYPES[str(t)] for c, t in zip(expected.columns, expected.types, strict=True)}
    assert dict(df.dtypes) == types
    columns = sorted(types)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    want = expected.select(*[f'"{c}"' for c in columns]).fetchall()
    assert len(got) > 0
    assert Counter(got) == Counter(want)


def test_smoke_entry(spark):
    assert entry(spark).count() == 5
