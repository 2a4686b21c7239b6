"""The seven studies. Each takes the survey tables and returns a report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.codes import (
    AGE_BINS,
    COMORBIDITY_LEVELS,
    CONDITIONS,
    DIABETES,
    ENOUGH_ANSWERS,
    GENDERS,
    HIGH_CHOLESTEROL,
    HYPERTENSION,
    OBESITY,
    OTHER_AGE,
    OTHER_GENDER,
    OVERWEIGHT_RANGE,
    PRESCRIPTION,
    answered_flag,
    confirmed_flag,
    present_flag,
)
from panelwise.functions.flags import bins, count_flags, decode, flag, two_way
from panelwise.functions.measures import (
    Measure,
    aggregate,
    mean,
    percent,
    row_count,
    total,
    total_where,
)
from panelwise.operators.joins import first_by_key
from panelwise.operators.membership import aggregate_membership
from panelwise.operators.ordering import label_rank, order_by_hidden, pinned_first
from panelwise.operators.totals import stack_measures, with_overall
from panelwise.plans.cohort import BASE, KEY, adults, answers_of, build_cohort

Tables = Mapping[str, DataFrame]

# Which columns of which table carry the answers.
CONDITION_ANSWERS = {
    "body_measures": ["bmxbmi"],
    "diabetes": ["diq010"],
    "bp_cholesterol_q": ["bpq020", "bpq080"],
}
COVERAGE_ANSWER = {"insurance": ["hiq011"]}
CARE_ANSWERS = {"healthcare_util": ["huq010", "huq030", "huq042", "huq055", "huq090"]}
DRUG_ANSWERS = {"medications": ["rxq033", "rxq050"]}
DIET_ANSWERS = {
    "healthcare_util": ["huq055"],
    "weight_history": ["whq070"],
    "dietary_total_day1": ["drqsdiet"],
}
SOURCES = [
    BASE,
    *(CONDITION_ANSWERS | COVERAGE_ANSWER | CARE_ANSWERS | DRUG_ANSWERS | DIET_ANSWERS),
]

# Labels of the reports.
INSURED, UNINSURED = "Insured", "Uninsured"
ALL_ADULTS = "All Adults (overall)"
ALL_RESPONDENTS = "Overall Respondents"
OVERALL = "OVERALL"


def insurance_status() -> Column:
    return two_way(F.col("hiq011") == 1, INSURED, UNINSURED)


def no_usual_place() -> Column:
    return flag(F.col("huq030") == 2)


def emergency_is_usual() -> Column:
    return flag(F.col("huq042") == 3)


def used_telehealth() -> Column:
    return flag(F.col("huq055") == 1)


def had_counseling() -> Column:
    return flag(F.col("huq090") == 1)


def takes_any_drug() -> Column:
    return present_flag(PRESCRIPTION)


def takes_at_least(drugs: int) -> Column:
    return flag(F.col("rxq050") >= drugs)


def condition_count() -> Column:
    return count_flags([confirmed_flag(c) for c in CONDITIONS.values()])


def enough_answers() -> Column:
    """Usable answers for at least three of the four conditions."""
    return count_flags([answered_flag(c) for c in CONDITIONS.values()]) >= ENOUGH_ANSWERS


def comorbidity_level() -> Column:
    return decode(F.col("condition_count"), COMORBIDITY_LEVELS).alias("comorbidity_level")


def condition_groups() -> dict[str, Column]:
    return {label: c.answered() & c.present() for label, c in CONDITIONS.items()}


def care_measures() -> list[Measure]:
    return [
        row_count("n"),
        percent("pct_no_usual_care", no_usual_place()),
        percent("pct_er_as_usual_care", emergency_is_usual()),
        percent("pct_used_telehealth", used_telehealth()),
    ]


def health_score() -> Measure:
    # Refused and don't-know codes stay in, as in the studies being matched.
    return mean("avg_health_score", F.col("huq010"))


def q1_overview(tables: Tables, n: int = 100) -> DataFrame:
    """Raw codes beside derived flags for the first adults by key."""
    base = adults(tables, ["ridageyr", "riagendr", "ridreth3", "indfmpir"])
    answers = answers_of(tables, CONDITION_ANSWERS | COVERAGE_ANSWER | CARE_ANSWERS)
    return first_by_key(base, answers, KEY, n).select(
        KEY,
        F.col("ridageyr").alias("age"),
        F.col("riagendr").alias("gender"),
        F.col("ridreth3").alias("race_ethnicity"),
        F.col("indfmpir").alias("income_poverty_ratio"),
        "bmxbmi",
        F.col("diq010").alias("diq010_raw"),
        F.col("bpq020").alias("bpq020_raw"),
        F.col("bpq080").alias("bpq080_raw"),
        present_flag(OBESITY).alias("is_obese"),
        flag(F.col("bmxbmi").between(*OVERWEIGHT_RANGE)).alias("is_overweight"),
        present_flag(DIABETES).alias("has_diabetes"),
        present_flag(HYPERTENSION).alias("has_hypertension"),
        present_flag(HIGH_CHOLESTEROL).alias("has_high_cholesterol"),
        insurance_status().alias("insurance_status"),
        F.col("huq010").alias("general_health"),
        no_usual_place().alias("no_usual_care_place"),
        F.col("huq042").alias("usual_care_type"),
        used_telehealth().alias("had_telehealth_visit"),
        had_counseling().alias("saw_mental_health_pro"),
    )


def q2_prevalence(tables: Tables) -> DataFrame:
    """Size of each condition, split by coverage, with its share of valid answers."""
    cohort = build_cohort(
        tables, CONDITION_ANSWERS | COVERAGE_ANSWER
    )
    cohort = cohort.withColumn("insurance_status", insurance_status())
    insured = F.col("insurance_status") == INSURED
    uninsured = F.col("insurance_status") == UNINSURED

    def line(trait: Column, answered: Column) -> list[Column]:
        return [
            total("total_respondents", trait).direct(),
            total_where("insured", insured, trait).direct(),
            total_where("uninsured", uninsured, trait).direct(),
            percent("pct_of_adults", trait, among=answered).direct(),
        ]

    measured = OBESITY.answered()
    rows = {ALL_ADULTS: line(flag(measured), measured)}
    for label, c in CONDITIONS.items():
        shown = "Diabetes (incl. borderline)" if c is DIABETES else label
        rows[shown] = line(present_flag(c), c.answered())
    names = ["total_respondents", "insured", "uninsured", "pct_of_adults"]
    return stack_measures(cohort, rows, "condition", names).orderBy("rank").drop("rank")


def q3_access_by_coverage(tables: Tables) -> DataFrame:
    """Access to care per condition and coverage."""
    cohort = build_cohort(
        tables, CONDITION_ANSWERS | COVERAGE_ANSWER | CARE_ANSWERS
    )
    cohort = cohort.withColumn("insurance_status", insurance_status())
    measures = [
        *care_measures(),
        percent("pct_mental_counseling", had_counseling()),
        health_score(),
    ]
    groups = {ALL_RESPONDENTS: F.lit(True), **condition_groups()}
    report = aggregate_membership(
        cohort, groups, "condition", ["insurance_status"], measures
    )
    return report.orderBy(
        pinned_first("condition", ALL_RESPONDENTS), "condition", "insurance_status"
    )


def q4_comorbidity(tables: Tables) -> DataFrame:
    """Access to care by number of conditions."""
    cohort = build_cohort(tables, CONDITION_ANSWERS | CARE_ANSWERS)
    measures = [*care_measures(), health_score()]
    counted = cohort.filter(enough_answers()).withColumn("condition_count", condition_count())
    report = aggregate(counted, ["condition_count"], measures)
    return order_by_hidden(
        report, "condition_count", [comorbidity_level(), *[m.name for m in measures]]
    )


def q5_high_value_cohorts(tables: Tables) -> DataFrame:
    """Willingness to use a remote diet service, by gender and age, and overall."""
    # Condition and coverage tables reach no output column; they only count where keys repeat.
    unread = {name: [] for name in CONDITION_ANSWERS | COVERAGE_ANSWER}
    cohort = build_cohort(
        tables,
        DIET_ANSWERS | unread,
        columns=["riagendr", "ridageyr"],
    ).select(
        "*",
        decode(F.col("riagendr"), GENDERS, OTHER_GENDER).alias("gender"),
        bins(F.col("ridageyr"), AGE_BINS, OTHER_AGE).alias("age_group"),
    )

    def share(name: str, column: str) -> Measure:
        answer = F.col(column)
        return percent(name, flag(answer == 1), among=answer.isNotNull())

    measures = [
        share("pct_of_adults_trying_to_lose_weight", "whq070"),
        share("pct_of_adults_on_diet", "drqsdiet"),
        share("pct_used_telehealth", "huq055"),
    ]
    report = with_overall(cohort, ["gender", "age_group"], measures, OVERALL)
    return report.orderBy("rank", "gender", "age_group").drop("rank")


def q6_medication_burden(tables: Tables) -> DataFrame:
    """Prescription burden per condition, among adults with a valid drug answer."""
    cohort = build_cohort(
        tables,
        DRUG_ANSWERS | CONDITION_ANSWERS,
        required={"medications": PRESCRIPTION.answered()},
    )
    measures = [
        row_count("n"),
        percent("pct_on_any_rx", takes_any_drug()),
        mean("avg_rx_count", F.col("rxq050"), where=takes_any_drug() == 1),
        percent("pct_polypharmacy", takes_at_least(3)),
    ]
    groups = {ALL_ADULTS: OBESITY.answered(), **condition_groups()}
    report = aggregate_membership(cohort, groups, "condition", [], measures)
    return report.orderBy(label_rank("condition", list(groups)))


def q7_rx_by_comorbidity(tables: Tables) -> DataFrame:
    """Prescription burden by number of conditions."""
    cohort = build_cohort(
        tables,
        DRUG_ANSWERS | CONDITION_ANSWERS | {"insurance": []},
        required={"medications": PRESCRIPTION.answered()},
    )
    measures = [
        row_count("n"),
        percent("pct_on_any_rx", takes_any_drug()),
        mean("avg_rx_count", F.col("rxq050"), where=takes_any_drug() == 1),
        percent("pct_polypharmacy_3plus", takes_at_least(3)),
        percent("pct_polypharmacy_5plus", takes_at_least(5)),
    ]
    counted = cohort.filter(enough_answers()).withColumn("condition_count", condition_count())
    report = aggregate(counted, ["condition_count"], measures)
    return order_by_hidden(
        report, "condition_count", [comorbidity_level(), *[m.name for m in measures]]
    )


STUDIES: dict[str, Callable[..., DataFrame]] = {
    "q1_overview": q1_overview,
    "q2_prevalence": q2_prevalence,
    "q3_access_by_coverage": q3_access_by_coverage,
    "q4_comorbidity": q4_comorbidity,
    "q5_high_value_cohorts": q5_high_value_cohorts,
    "q6_medication_burden": q6_medication_burden,
    "q7_rx_by_comorbidity": q7_rx_by_comorbidity,
}
