"""Joins of one-row-per-respondent tables on the respondent key."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

UNIQUE = "unique_key"
HOTTEST = "hottest_rows"
MATCH = "__match"
#: Keys that a sketch of frequent keys keeps count of, and its error as a share of all rows.
SKETCHED = 100_000
SKETCH_ERROR = 4 / SKETCHED
#: So many rows of one key may meet in one task of a join.
HOT_ROWS = 1_000_000


class DuplicateKeyError(ValueError):
    """A table that must hold each key once does not."""


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often. Null keys join nothing and do not count.

    The count is combined before the shuffle, so one key that holds most of
    the table costs no more than any other. A table bucketed by the key is
    counted without a shuffle.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Return `df` if `key` is unique in it, else raise naming a few culprits."""
    raise_repeated(duplicate_keys(df, key), key)
    return df


def raise_repeated(repeated: DataFrame, key: str) -> None:
    """Raise if there are any keys with their counts, naming a few."""
    culprits = repeated.limit(5).collect()
    if culprits:
        shown = ", ".join(f"{row[0]} ({row[1]} rows)" for row in culprits)
        raise DuplicateKeyError(f"{key} is not unique: {shown}")


def mark_unique(df: DataFrame, key: str) -> DataFrame:
    """`df` with a note in its key column that each key occurs once.

    The note is column metadata, so stored tables keep it. The load sets it on
    tables whose key it checks.
    """
    return df.withMetadata(key, {**df.schema[key].metadata, UNIQUE: True})


def known_unique(df: DataFrame, key: str) -> bool:
    return bool(df.schema[key].metadata.get(UNIQUE))


def hottest_sketch(key: str) -> Column:
    """The two commonest keys, one of which may be null, by a sketch of frequent items: one pass, bounded memory."""
    return F.expr(f"approx_top_k(`{key}`, 2, {SKETCHED})")


def hottest_rows(top: Sequence[Row] | None, rows: int) -> int:
    """The most rows any key can have, from the sketch of a table of `rows` rows. Never too low."""
    seen = max((item["count"] for item in top or () if item["item"] is not None), default=0)
    return min(rows, seen + math.ceil(SKETCH_ERROR * rows))


def note_hottest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """`df` with a note in its key column of how many rows its commonest key has at most.

    The load sets it on tables whose key it does not check.
    """
    return df.withMetadata(key, {**df.schema[key].metadata, HOTTEST: rows})


def sketch_hottest(df: DataFrame, key: str) -> DataFrame:
    """`note_hottest` for a table that no load has looked at: reads its key once."""
    found = df.agg(F.count(F.lit(1)).alias("rows"), hottest_sketch(key).alias("top")).first()
    return note_hottest(df, key, hottest_rows(found.top, found.rows))


def may_be_hot(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> bool:
    """Whether some key may have more rows than one task should join."""
    notes = df.schema[key].metadata
    return not notes.get(UNIQUE) and notes.get(HOTTEST, math.inf) > hot_rows


def star_left_join(
    base: DataFrame,
    tables: Mapping[str, DataFrame],
    key: str,
    required: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join every table onto `base`, keeping base rows without a match.

    Tables named in `required` are joined first and inner, for studies whose
    filter would drop the unmatched rows anyway. A table that brings nothing
    but a key known to be unique is left out unless it is required, as it
    cannot change the rows. All joins share one key, so each input is shuffled
    at most once and the running result is never shuffled again; inputs
    bucketed by the key are not shuffled at all.

    A key with more than `hot_rows` rows is hot, and Spark cannot split the
    right side of a left join. A table that may hold one, because its load or
    `sketch_hottest` found one or because nobody looked, is completed by the
    base keys it lacks and joined inner, where either side of a hot partition
    is split. Only such tables pay for that.
    """
    names = [n for n in tables if n in required]
    names += [n for n in tables if n not in required and not _adds_nothing(tables[n], key)]

    def attach(left: DataFrame, name: str) -> DataFrame:
        if name in required:
            return left.join(tables[name], key)
        if not may_be_hot(tables[name], key, hot_rows):
            return left.join(tables[name], key, "left")
        right = _completed(tables[name], base, key).withColumnRenamed(key, MATCH)
        return left.join(right, F.col(key).eqNullSafe(F.col(MATCH))).drop(MATCH)

    return reduce(attach, names, base)


def _adds_nothing(df: DataFrame, key: str) -> bool:
    return df.columns == [key] and known_unique(df, key)


def _completed(df: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows of `df` with a key, and an empty row for each key of `base`, null too, that it lacks."""
    given = df.where(F.col(key).isNotNull())
    lacking = base.select(key).distinct().join(given.select(key).distinct(), key, "left_anti")
    return given.unionByName(lacking, allowMissingColumns=True)


def first_by_key(
    base: DataFrame, tables: Mapping[str, DataFrame], key: str, n: int
) -> DataFrame:
    """The first `n` rows of the star join in key order.

    Left joins keep every base row, so the first `n` base rows decide which
    keys can appear. The other tables are cut to those keys by a semi join
    whose small side is `n` rows at most; Spark broadcasts it while that is few,
    so that no large table is shuffled.
    """
    top = base.orderBy(key).limit(n)
    wanted = top.select(key)
    cut = {name: df.join(wanted, key, "left_semi") for name, df in tables.items()}
    return star_left_join(top, cut, key).orderBy(key).limit(n)
