"""Rows that summarise other rows: stacked measures and overall rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.measures import Measure, finish, partial


def stack_measures(
    df: DataFrame, rows: Mapping[str, Sequence[Column]], label: str, names: Sequence[str]
) -> DataFrame:
    """One labelled row per entry, all computed by one global aggregate.

    The aggregate has a row even for empty input, so every label is always
    present. A `rank` column gives the order of the entries.
    """
    wide = df.agg(
        *[c.alias(f"c{i}_{j}") for i, cells in enumerate(rows.values())
          for j, c in enumerate(cells)]
    )
    line = [
        F.struct(
            F.lit(i).alias("rank"),
            F.lit(text).alias(label),
            *[F.col(f"c{i}_{j}").alias(n) for j, n in enumerate(names)],
        )
        for i, text in enumerate(rows)
    ]
    return wide.select(F.inline(F.array(*line)))


def with_overall(
    df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], overall: str
) -> DataFrame:
    """Grouped measures plus one row over everything, labelled `overall`.

    Both halves are finished from the same per-group sums, whose shuffle Spark
    runs once and reuses. The overall half is a true global aggregate, so it
    is there even when the input is empty. `rank` is 0 for groups, 1 overall.
    """
    sums = partial(df, keys, measures)
    detail = finish(sums, keys, measures).withColumn("rank", F.lit(0))
    whole = finish(sums, [], measures).select(
        *[F.lit(overall).alias(k) for k in keys], *[m.name for m in measures],
        F.lit(1).alias("rank"),
    )
    return detail.unionByName(whole)
