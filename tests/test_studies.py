"""The studies against plain Python over random surveys, row order included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelwise.operators.joins import mark_unique
from panelwise.plans.studies import STUDIES
from tests import survey as plain

EXPECTED = {
    "q2_prevalence": plain.prevalence,
    "q3_access_by_coverage": plain.access,
    "q4_comorbidity": plain.comorbidity,
    "q5_high_value_cohorts": plain.diet_interest,
    "q6_medication_burden": plain.medication,
    "q7_rx_by_comorbidity": plain.prescriptions,
}


def tables_of(spark, survey):
    return {t: spark.createDataFrame(rows, plain.schema(t)) for t, rows in survey.items()}


def result(df):
    return [tuple(row) for row in df.collect()]


@pytest.mark.parametrize("people", [400, 25])
@pytest.mark.parametrize("name", EXPECTED)
def test_study_equals_plain_python(name, people, spark):
    survey = plain.random_survey(people, people)
    got = result(STUDIES[name](tables_of(spark, survey)))
    if name == "q3_access_by_coverage":
        # Python's and Spark's order of labels agree: both compare code points.
        assert [r[:2] for r in got] == [r[:2] for r in plain.access(plain.adults(survey))]
    assert got == EXPECTED[name](plain.adults(survey))


@pytest.mark.parametrize("name", EXPECTED)
def test_study_over_nobody(name, spark):
    survey = {table: [] for table in plain.COLUMNS}
    assert result(STUDIES[name](tables_of(spark, survey))) == EXPECTED[name]([])


@pytest.mark.parametrize("name", EXPECTED)
def test_study_over_people_without_answers(name, spark):
    survey = {table: [] for table in plain.COLUMNS}
    survey["demographics"] = [(i, 30.0, 1.0, 1.0, None) for i in range(5)]
    got = result(STUDIES[name](tables_of(spark, survey)))
    assert got == EXPECTED[name](plain.adults(survey))


def test_overview_shows_codes_beside_flags(spark):
    survey = plain.random_survey(5, 300)
    people = sorted(plain.adults(survey), key=lambda p: p["seqn"])[:100]
    rows = STUDIES["q1_overview"](tables_of(spark, survey)).collect()
    assert [r.seqn for r in rows] == [p["seqn"] for p in people]
    for r, p in zip(rows, people, strict=True):
        assert (r.age, r.gender, r.bmxbmi, r.diq010_raw) == (
            p["ridageyr"], p["riagendr"], p["bmxbmi"], p["diq010"]
        )
        bmi = p["bmxbmi"]
        assert r.is_overweight == int(bmi is not None and 25 <= bmi <= 29.9)
        assert r.insurance_status == plain.status(p)
        flags = (r.is_obese, r.has_diabetes, r.has_hypertension, r.has_high_cholesterol)
        assert flags == tuple(int(plain.has(c, p)) for c in plain.LABELS)
        assert (r.no_usual_care_place, r.had_telehealth_visit, r.saw_mental_health_pro) == (
            int(p["huq030"] == 2), int(p["huq055"] == 1), int(p["huq090"] == 1)
        )
        assert (r.general_health, r.usual_care_type) == (p["huq010"], p["huq042"])


def test_overview_takes_fewer_rows_when_there_are_fewer(spark):
    survey = plain.random_survey(6, 10)
    assert STUDIES["q1_overview"](tables_of(spark, survey)).count() == len(plain.adults(survey))


@pytest.mark.parametrize("name", STUDIES)
def test_partitioning_and_join_strategy_change_nothing(name, spark):
    tables = tables_of(spark, plain.random_survey(8, 300))
    want = result(STUDIES[name](tables))
    one = {t: df.coalesce(1) for t, df in tables.items()}
    shuffled = {t: df.repartition(16).orderBy(F.hash("seqn")) for t, df in tables.items()}
    assert result(STUDIES[name](one)) == want
    assert result(STUDIES[name](shuffled)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert result(STUDIES[name](tables)) == want
        checked = {t: mark_unique(df, "seqn") for t, df in tables.items()}
        assert result(STUDIES[name](checked)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("name", "unread"), [("q5_high_value_cohorts", "body_measures"), ("q7_rx_by_comorbidity", "insurance")])
def test_repeated_keys_of_an_unread_table_count(name, unread, spark):
    survey = plain.random_survey(9, 200)
    young = survey[unread][:60]
    repeated = survey | {unread: [*survey[unread], *young, *young]}
    # The plain join of the base with the repeated keys is a base with repeated rows.
    times = {row[0]: 3 for row in young}
    base = [row for row in survey["demographics"] for _ in range(times.get(row[0], 1))]
    tables = tables_of(spark, repeated)
    same = tables_of(spark, survey | {"demographics": base})
    assert result(STUDIES[name](tables)) == result(STUDIES[name](same))
