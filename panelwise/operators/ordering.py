"""Report orders that are not the natural order of a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned_first(column: str, label: str) -> Column:
    """Sort key that puts one label before all others."""
    return F.when(F.col(column) == label, 0).otherwise(1)


def label_rank(column: str, labels: Sequence[str]) -> Column:
    """Position of the label in a list; unlisted labels sort first, as null."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(labels))):
        rank = F.when(F.col(column) == labels[i], i).otherwise(rank)
    return rank


def order_by_hidden(df: DataFrame, key: str, shown: Sequence[Column]) -> DataFrame:
    """Sort by a key that is not itself part of the output."""
    return df.orderBy(key).select(*shown)
