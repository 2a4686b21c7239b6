"""Row-level expressions: flags, labels, bins. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 when the condition is true, 0 when it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def two_way(condition: Column, yes: str, no: str) -> Column:
    """One of two labels; unknown counts as `no`."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def decode(column: Column, labels: Mapping[int, str], other: str | None = None) -> Column:
    """Label for a code. Unlisted codes and null give `other` (null by default).

    `other` must be text: under ANSI rules a numeric fallback would make Spark
    cast every label to a number.
    """
    arms = F.lit(None).cast("string") if other is None else F.lit(other)
    for code, label in reversed(labels.items()):
        arms = F.when(column == code, F.lit(label)).otherwise(arms)
    return arms


def bins(column: Column, ranges: Sequence[tuple[float, float, str]], other: str) -> Column:
    """Label of the first closed range that holds the value, else `other`.

    Values in a gap between two ranges, beyond the last one, or null are `other`.
    """
    arms = F.lit(other)
    for low, high, label in reversed(ranges):
        arms = F.when(column.between(low, high), F.lit(label)).otherwise(arms)
    return arms


def count_flags(flags: Sequence[Column]) -> Column:
    """How many of the 0/1 flags are set."""
    return reduce(add, flags)
