"""Aggregate measures that can be summed in steps.

Every measure is kept as a few row-level expressions whose plain sums decide
the result. Sums of sums are still the same sums, so one measure serves a
single `groupBy`, a second aggregation over already grouped rows, and an
overall row over the groups, and the big side always has a map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.flags import flag


@dataclass(frozen=True)
class Measure:
    name: str
    terms: tuple[Column, ...]
    finish: Callable[..., Column]

    def part_names(self) -> list[str]:
        return [f"{self.name}__{i}" for i in range(len(self.terms))]

    def parts(self) -> list[Column]:
        """Sums over rows, named so that `merged` can pick them up."""
        return [F.sum(t).alias(p) for t, p in zip(self.terms, self.part_names(), strict=True)]

    def merged(self) -> Column:
        """The measure over rows that already hold its parts."""
        return self.finish(*[F.sum(p) for p in self.part_names()]).alias(self.name)

    def direct(self) -> Column:
        """The measure over plain rows."""
        return self.finish(*[F.sum(t) for t in self.terms]).alias(self.name)


def row_count(name: str) -> Measure:
    """COUNT(*): 0 when there are no rows."""
    return Measure(name, (F.lit(1),), lambda n: F.coalesce(n, F.lit(0).cast("bigint")))


def total(name: str, value: Column) -> Measure:
    """SUM of a flag: null when there are no rows."""
    return Measure(name, (value,), lambda s: s)


def total_where(name: str, test: Column, value: Column) -> Measure:
    """SUM of `value` over rows that pass; rows that fail add 0."""
    return total(name, F.when(test, value).otherwise(0))


def count_where(name: str, test: Column) -> Measure:
    """Number of rows that pass; null (not 0) when there are no rows at all."""
    return total(name, flag(test))


def ratio(numerator: Column, denominator: Column, places: int = 1) -> Column:
    """A percentage in double arithmetic; null when the denominator is 0."""
    return F.round(F.try_divide(F.lit(100.0) * numerator, denominator), places)


def percent(name: str, trait: Column, among: Column | None = None, places: int = 1) -> Measure:
    """Share of rows with the trait, over all rows or over those passing `among`."""
    base = F.lit(1) if among is None else flag(among)
    return Measure(name, (trait, base), lambda num, den: ratio(num, den, places))


def mean(name: str, value: Column, where: Column | None = None, places: int = 2) -> Measure:
    """Mean of the non-null values, optionally only of rows passing `where`."""
    v = value.cast("double")
    if where is not None:
        v = F.when(where, v)
    return Measure(
        name,
        (v, flag(v.isNotNull())),
        lambda s, n: F.round(F.try_divide(s, n), places),
    )


def aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per key; without keys always exactly one row."""
    columns = [m.direct() for m in measures]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def partial(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Parts of the measures per key, to be finished later with `finish`."""
    return df.groupBy(*keys).agg(*[p for m in measures for p in m.parts()])


def finish(parts: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Combine parts into measures; without keys always exactly one row."""
    columns = [m.merged() for m in measures]
    return parts.groupBy(*keys).agg(*columns) if keys else parts.agg(*columns)
