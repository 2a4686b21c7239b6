"""Overlapping groups: one respondent may belong to several at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.measures import Measure, finish, partial

PATTERN = "__pattern"


def expand_membership(df: DataFrame, groups: Mapping[str, Column], name: str) -> DataFrame:
    """One output row per row and group it belongs to, in a single pass.

    Gives the rows of a UNION ALL of one filtered branch per group without
    reading the input once per branch.
    """
    labels = F.array(*[F.when(test, F.lit(label)) for label, test in groups.items()])
    return df.withColumn(name, F.explode(F.array_compact(labels)))


def aggregate_membership(
    df: DataFrame,
    groups: Mapping[str, Column],
    name: str,
    keys: Sequence[str],
    measures: Sequence[Measure],
) -> DataFrame:
    """Measures per group and `keys`, without multiplying the input rows.

    Rows are first summed by their pattern of memberships (one bit per group,
    so at most 2^groups patterns per key) and only these sums are expanded.
    Rows in no group end in the pattern without bits, which expands to nothing.
    """
    bits = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(groups.values())]
    coded = df.withColumn(PATTERN, reduce(Column.__add__, bits))
    sums = partial(coded, [PATTERN, *keys], measures)
    held = {
        label: F.col(PATTERN).bitwiseAND(1 << i) > 0 for i, label in enumerate(groups)
    }
    return finish(expand_membership(sums, held, name), [name, *keys], measures)
