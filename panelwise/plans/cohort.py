"""The adult cohort: demographics with the answers a study needs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.codes import ADULT_AGE
from panelwise.operators.joins import star_left_join

KEY = "seqn"
BASE = "demographics"


def adults(tables: Mapping[str, DataFrame], columns: Sequence[str] = ()) -> DataFrame:
    """Adult respondents with the asked-for demographic columns."""
    return tables[BASE].filter(F.col("ridageyr") >= ADULT_AGE).select(KEY, *columns)


def answers_of(
    tables: Mapping[str, DataFrame], answers: Mapping[str, Sequence[str]]
) -> dict[str, DataFrame]:
    """The named columns of each table, with the key."""
    return {name: tables[name].select(KEY, *columns) for name, columns in answers.items()}


def build_cohort(
    tables: Mapping[str, DataFrame],
    answers: Mapping[str, Sequence[str]],
    columns: Sequence[str] = (),
    required: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per adult with the answers of every table in `answers`.

    `required` maps a table to a test on its rows; adults without a row that
    passes are dropped.
    """
    frames = answers_of(tables, answers)
    required = required or {}
    for name, test in required.items():
        frames[name] = frames[name].filter(test)
    return star_left_join(adults(tables, columns), frames, KEY, required=list(required))
