"""The check for each query: the same result as one SQL statement.

Written apart from the DataFrame code, so that a mistake has to be made twice
to go unseen: null-safe truth values and FILTER instead of 0/1 flags, UNION ALL
of branches instead of membership patterns, plain joins instead of pruned ones.
Means are rounded as decimals, because binary rounding to two places differs
between engines.
"""

from __future__ import annotations

from catalogue.queries import SAMPLE_TABLES
from panelwise.fixtures.respondents import view_sql

ORACLE: dict[str, str] = {}


def views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({view_sql(n)})" for n in names)


def cohort(*names: str, inner: str | None = None) -> str:
    """Adults with every column of the named tables."""
    joins = " ".join(
        f"{'JOIN' if n == inner else 'LEFT JOIN'} {n} USING (seqn)" for n in names
    )
    return (
        views("demographics", *names)
        + f",\ncohort AS (SELECT * FROM demographics {joins} WHERE ridageyr >= 18)\n"
    )


def share(part: str, whole: str = "count(*)") -> str:
    return f"round(100.0::DOUBLE * {part} / NULLIF({whole}, 0), 1)"


def many(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


def mean2(value: str) -> str:
    return f"round(CAST({value} AS DECIMAL(20,10)), 2)::DOUBLE"


def bit(test: str) -> str:
    return f"coalesce({test}, false)::INTEGER"


CONDITIONS_FROM = ("body_measures", "diabetes", "bp_cholesterol_q")
# label -> (usable answer, yes)
TESTS = {
    "Obesity": ("bmxbmi IS NOT NULL", "bmxbmi >= 30"),
    "Diabetes": ("diq010 IN (1, 2, 3)", "diq010 IN (1, 3)"),
    "Hypertension": ("bpq020 IN (1, 2)", "bpq020 = 1"),
    "High Cholesterol": ("bpq080 IN (1, 2)", "bpq080 = 1"),
}
N_ANSWERED = " + ".join(bit(answered) for answered, _ in TESTS.values())
N_PRESENT = " + ".join(bit(f"{answered} AND {yes}") for answered, yes in TESTS.values())
COVERED = "CASE WHEN hiq011 = 1 THEN 'Insured' ELSE 'Uninsured' END"
GENDER = "CASE riagendr WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE '0' END"
LEVEL = (
    "CASE condition_count WHEN 0 THEN '0 - No conditions' WHEN 1 THEN '1 - Single condition'"
    " WHEN 2 THEN '2 - Two conditions' WHEN 3 THEN '3 - Three conditions'"
    " WHEN 4 THEN '4 - All four conditions' END"
)
AGE_GROUP = (
    "CASE WHEN ridageyr >= 18 AND ridageyr <= 25 THEN '18-25'"
    " WHEN ridageyr >= 26 AND ridageyr <= 35 THEN '26-35'"
    " WHEN ridageyr >= 36 AND ridageyr <= 45 THEN '36-45'"
    " WHEN ridageyr >= 46 AND ridageyr <= 55 THEN '46-55'"
    " WHEN ridageyr >= 56 AND ridageyr <= 65 THEN '56-65'"
    " WHEN ridageyr >= 66 AND ridageyr <= 75 THEN '66-75'"
    " WHEN ridageyr >= 76 AND ridageyr <= 80 THEN '76+' ELSE '<18' END"
)


def members(first: str, first_test: str, columns: str) -> str:
    branches = {first: first_test} | {
        label: f"{answered} AND {yes}" for label, (answered, yes) in TESTS.items()
    }
    return " UNION ALL ".join(
        f"SELECT '{label}' AS condition, {columns} FROM cohort WHERE {test}"
        for label, test in branches.items()
    )


CARE_SHARES = f"""
    {share(many('huq030 = 2'))} AS pct_no_usual_care,
    {share(many('huq042 = 3'))} AS pct_er_as_usual_care,
    {share(many('huq055 = 1'))} AS pct_used_telehealth"""

# Studies

ORACLE["q1_overview"] = cohort(*CONDITIONS_FROM, "insurance", "healthcare_util") + f"""
SELECT seqn, ridageyr AS age, riagendr AS gender, ridreth3 AS race_ethnicity,
    indfmpir AS income_poverty_ratio, bmxbmi,
    diq010 AS diq010_raw, bpq020 AS bpq020_raw, bpq080 AS bpq080_raw,
    {bit('bmxbmi >= 30')} AS is_obese,
    {bit('bmxbmi >= 25 AND bmxbmi <= 29.9::DOUBLE')} AS is_overweight,
    {bit('diq010 IN (1, 3)')} AS has_diabetes,
    {bit('bpq020 = 1')} AS has_hypertension,
    {bit('bpq080 = 1')} AS has_high_cholesterol,
    {COVERED} AS insurance_status,
    huq010 AS general_health,
    {bit('huq030 = 2')} AS no_usual_care_place,
    huq042 AS usual_care_type,
    {bit('huq055 = 1')} AS had_telehealth_visit,
    {bit('huq090 = 1')} AS saw_mental_health_pro
FROM cohort ORDER BY seqn LIMIT 100"""


def _prevalence() -> str:
    tests = {"All Adults (overall)": ("bmxbmi IS NOT NULL", "bmxbmi IS NOT NULL"), **TESTS}
    lines = " UNION ALL ".join(
        f"SELECT '{label}' AS condition, hiq011, {answered} AS answered, {yes} AS yes FROM cohort"
        for label, (answered, yes) in tests.items()
    )
    return cohort(*CONDITIONS_FROM, "insurance") + f"""
SELECT CASE condition WHEN 'Diabetes' THEN 'Diabetes (incl. borderline)'
        ELSE condition END AS condition,
    {many('yes')} AS total_respondents,
    {many('yes AND hiq011 = 1')} AS insured,
    {many('yes AND hiq011 IS DISTINCT FROM 1')} AS uninsured,
    {share(many('yes'), many('answered'))} AS pct_of_adults
FROM ({lines}) GROUP BY condition"""


ORACLE["q2_prevalence"] = _prevalence()

ORACLE["q3_access_by_coverage"] = (
    cohort(*CONDITIONS_FROM, "insurance", "healthcare_util")
    + f"""
SELECT condition, {COVERED} AS insurance_status, count(*) AS n, {CARE_SHARES},
    {share(many('huq090 = 1'))} AS pct_mental_counseling,
    {mean2('avg(huq010)')} AS avg_health_score
FROM ({members('Overall Respondents', 'true', '*')})
GROUP BY ALL"""
)

ORACLE["q4_comorbidity"] = cohort(*CONDITIONS_FROM, "healthcare_util") + f"""
SELECT {LEVEL} AS comorbidity_level, count(*) AS n, {CARE_SHARES},
    {mean2('avg(huq010)')} AS avg_health_score
FROM (SELECT *, {N_PRESENT} AS condition_count FROM cohort WHERE {N_ANSWERED} >= 3)
GROUP BY condition_count"""

_DIET = f"""
    {share(many('whq070 = 1'), 'count(whq070)')} AS pct_of_adults_trying_to_lose_weight,
    {share(many('drqsdiet = 1'), 'count(drqsdiet)')} AS pct_of_adults_on_diet,
    {share(many('huq055 = 1'), 'count(huq055)')} AS pct_used_telehealth"""
ORACLE["q5_high_value_cohorts"] = (
    cohort(
        "healthcare_util", *CONDITIONS_FROM, "insurance", "weight_history", "dietary_total_day1"
    )
    + f"""
SELECT {GENDER} AS gender, {AGE_GROUP} AS age_group, {_DIET} FROM cohort GROUP BY 1, 2
UNION ALL
SELECT 'OVERALL', 'OVERALL', {_DIET} FROM cohort"""
)

_DRUGS = f"""
    count(*) AS n,
    {share(many('rxq033 = 1'))} AS pct_on_any_rx,
    {mean2('avg(rxq050) FILTER (WHERE rxq033 = 1)')} AS avg_rx_count"""
ORACLE["q6_medication_burden"] = (
    cohort(*CONDITIONS_FROM, "medications")
    + f"""
SELECT condition, {_DRUGS}, {share(many('rxq050 >= 3'))} AS pct_polypharmacy
FROM ({members('All Adults (overall)', 'bmxbmi IS NOT NULL', '*')})
WHERE rxq033 IN (1, 2) GROUP BY condition"""
)

ORACLE["q7_rx_by_comorbidity"] = (
    cohort(*CONDITIONS_FROM, "insurance", "medications")
    + f"""
SELECT {LEVEL} AS comorbidity_level, {_DRUGS},
    {share(many('rxq050 >= 3'))} AS pct_polypharmacy_3plus,
    {share(many('rxq050 >= 5'))} AS pct_polypharmacy_5plus
FROM (SELECT *, {N_PRESENT} AS condition_count FROM cohort
    WHERE rxq033 IN (1, 2) AND {N_ANSWERED} >= 3)
GROUP BY condition_count"""
)

# Sources, sinks, ingest

ORACLE["op_project_alias"] = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS price,
    'order' AS kind FROM orders"""
ORACLE["op_lowercase_columns"] = ORACLE["op_replace_sink"] = """
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority FROM orders"""
ORACLE["op_versioned_replace"] = """
SELECT o_orderkey, o_totalprice, coalesce(n_lines, 0) AS n_lines FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
ORACLE["op_snapshot_scan"] = "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
ORACLE["op_xport_columns"] = "SELECT o_orderkey, o_orderpriority FROM orders"
ORACLE["op_xport_roundtrip"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"""


def _counts(extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {extra} count(*) AS \"rows\" FROM {t}" for t in SAMPLE_TABLES
    )


ORACLE["op_load_counts"] = _counts()
ORACLE["op_load_resume"] = f"""
SELECT "table", "rows", "table" IN ('region', 'nation', 'customer', 'supplier', 'part') AS resumed FROM ({_counts()})"""
ORACLE["op_load_status"] = f"""
SELECT "table" || '.parquet' AS file, "table", 'loaded' AS status,
    NULL::VARCHAR AS reason, "rows" FROM ({_counts()})
UNION ALL SELECT 'absent.parquet', 'absent', 'failed', 'download failed', NULL"""
ORACLE["op_registry_join"] = f"""
SELECT "table" || '.parquet' AS file, "table", 'sample table ' || "table" AS description,
    'loaded' AS status, "rows" FROM ({_counts()})"""


def _mark_in_head(mark: str) -> str:
    # A mark is in the head if its first occurrence ends within 1024 bytes.
    end = f"octet_length(encode(left(html, strpos(html, '{mark}') + {len(mark)} - 1)))"
    return f"(strpos(html, '{mark}') > 0 AND {end} <= 1024)"


ORACLE["op_error_page_guard"] = f"""
SELECT page_id, coalesce({_mark_in_head('<!DOCTYPE html')} AND {_mark_in_head('lang="es"')},
    false)::INTEGER AS is_error_page FROM pages"""

# Projections and scalar expressions

ORACLE["op_threshold_flag"] = cohort("body_measures", "medications") + f"""
SELECT seqn, {bit('bmxbmi >= 30')} AS is_obese, {bit('rxq050 >= 3')} AS is_polypharmacy,
    {bit('rxq050 >= 5')} AS is_high_polypharmacy FROM cohort"""
ORACLE["op_range_flag"] = cohort("body_measures") + f"""
SELECT seqn, {bit('bmxbmi >= 25 AND bmxbmi <= 29.9::DOUBLE')} AS is_overweight FROM cohort"""
ORACLE["op_inlist_flag"] = cohort("diabetes") + f"""
SELECT seqn, {bit('diq010 = 1 OR diq010 = 3')} AS has_diabetes FROM cohort"""
ORACLE["op_equality_flag"] = cohort("healthcare_util") + f"""
SELECT seqn, {bit('huq030 = 2')} AS no_usual_care_place,
    {bit('huq055 = 1')} AS had_telehealth FROM cohort"""
ORACLE["op_valid_flags"] = cohort(*CONDITIONS_FROM) + "SELECT seqn, " + ", ".join(
    f"{bit(answered)} AS {name}"
    for name, (answered, _) in zip(
        ("has_bmi_data", "has_diabetes_data", "has_bp_data", "has_chol_data"),
        TESTS.values(), strict=True,
    )
) + " FROM cohort"
ORACLE["op_flag_count"] = cohort(*CONDITIONS_FROM) + f"""
SELECT seqn, {N_ANSWERED} AS n_answered, {N_PRESENT} AS condition_count FROM cohort"""
ORACLE["op_two_way_label"] = cohort("insurance") + f"""
SELECT seqn, {COVERED} AS insurance_status FROM cohort"""
ORACLE["op_code_decode"] = views("demographics") + f"""
SELECT seqn, {GENDER} AS gender FROM demographics"""
ORACLE["op_bins"] = views("demographics") + f"""
SELECT seqn, {AGE_GROUP} AS age_group FROM demographics"""
ORACLE["op_simple_case_label"] = cohort(*CONDITIONS_FROM) + f"""
SELECT condition_count, {LEVEL} AS comorbidity_level,
    CASE condition_count WHEN 0 THEN 'none' END AS only_zero_labelled, count(*) AS n
FROM (SELECT {N_PRESENT} AS condition_count FROM cohort) GROUP BY condition_count"""
ORACLE["op_round"] = cohort("body_measures") + """
SELECT seqn, round(CAST(indfmpir AS DECIMAL(20,10)), 1)::DOUBLE AS income_1,
    round(CAST(bmxbmi / 7 AS DECIMAL(20,10)), 2)::DOUBLE AS bmi_2 FROM cohort"""
ORACLE["op_mean_float"] = cohort("healthcare_util") + f"""
SELECT ridreth3, {mean2('avg(huq010)')} AS avg_health_score FROM cohort GROUP BY ridreth3"""
ORACLE["op_cond_mean"] = cohort("medications") + f"""
SELECT ridreth3, {mean2('avg(rxq050) FILTER (WHERE rxq033 = 1)')} AS avg_rx_count
FROM cohort GROUP BY ridreth3"""

# Filters

ORACLE["op_filter_range"] = views("demographics") + """
SELECT seqn, ridageyr FROM demographics WHERE ridageyr >= 18"""
ORACLE["op_filter_not_null"] = cohort("body_measures") + """
SELECT seqn, bmxbmi FROM cohort WHERE bmxbmi IS NOT NULL AND bmxbmi >= 30"""
ORACLE["op_completeness_filter"] = cohort(*CONDITIONS_FROM) + f"""
SELECT seqn, bmxbmi, diq010, bpq020, bpq080 FROM cohort WHERE {N_ANSWERED} >= 3"""

# Joins

ORACLE["op_left_join"] = """
SELECT o_orderkey, o_custkey, n_lines, sum_qty FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""
ORACLE["op_sketched_left_join"] = """
SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"""
ORACLE["op_left_join_star"] = cohort(*CONDITIONS_FROM, "insurance", "healthcare_util") + """
SELECT seqn, ridageyr, bmxbmi, diq010, bpq020, bpq080, hiq011,
    huq010, huq030, huq042, huq055, huq090 FROM cohort"""
ORACLE["op_filtered_outer_join"] = cohort("medications") + """
SELECT seqn, rxq033, rxq050 FROM cohort WHERE rxq033 IN (1, 2)"""
ORACLE["op_unused_join_prune"] = cohort("insurance", "weight_history") + """
SELECT seqn, whq070 FROM cohort"""
ORACLE["op_unique_key_check"] = ORACLE["op_key_ranges"] = """
SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1"""

# Aggregations

ORACLE["op_global_agg"] = f"""
SELECT count(*) AS n, sum(l_quantity) AS sum_qty, {many("l_returnflag = 'R'")} AS n_returned
FROM lineitem"""
ORACLE["op_group_one"] = """
SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sum_qty
FROM lineitem GROUP BY l_returnflag"""
ORACLE["op_group_two"] = f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, {mean2('avg(l_quantity)')} AS avg_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus"""
ORACLE["op_sum_flags"] = f"""
SELECT o_orderpriority, {many("o_orderstatus = 'F'")} AS n_finished,
    {many('o_totalprice >= 100000')} AS n_large FROM orders GROUP BY o_orderpriority"""
ORACLE["op_cond_sum"] = f"""
SELECT o_orderpriority,
    {many("o_orderstatus = 'F' AND o_totalprice >= 100000")} AS large_finished,
    {many("o_orderstatus = 'O' AND o_totalprice >= 100000")} AS large_open
FROM orders GROUP BY o_orderpriority"""
ORACLE["op_cond_count"] = f"""
SELECT l_linestatus, {many('l_quantity >= 10 AND l_quantity <= 20')} AS n_mid_qty,
    count(l_discount) AS n_discounted FROM lineitem GROUP BY l_linestatus"""
ORACLE["op_pct_count"] = cohort("healthcare_util") + f"""
SELECT ridreth3, {share(many('huq030 = 2'))} AS pct_no_usual_care
FROM cohort GROUP BY ridreth3"""
ORACLE["op_pct_valid"] = cohort("diabetes") + f"""
SELECT ridreth3, {share(many('diq010 IN (1, 3)'), many('diq010 IN (1, 2, 3)'))} AS pct_diabetes
FROM cohort GROUP BY ridreth3"""
ORACLE["op_pct_answered"] = cohort("weight_history") + f"""
SELECT ridreth3, {share(many('whq070 = 1'), 'count(whq070)')} AS pct_lose_weight
FROM cohort GROUP BY ridreth3"""
ORACLE["op_detail_plus_overall"] = cohort("healthcare_util") + f"""
SELECT {GENDER} AS gender, count(*) AS n, {share(many('huq055 = 1'))} AS pct_used_telehealth,
    0 AS rank FROM cohort GROUP BY 1
UNION ALL
SELECT 'OVERALL', count(*), {share(many('huq055 = 1'))}, 1 FROM cohort"""

# Set operations, subqueries, ordering, limits

ORACLE["op_union_all_measures"] = cohort(*CONDITIONS_FROM) + " UNION ALL ".join(
    f"SELECT {i} AS rank, '{label}' AS condition, {many(answered)} AS n_answered,"
    f" {many(yes)} AS n_present FROM cohort"
    for i, (label, (answered, yes)) in enumerate(TESTS.items())
)
ORACLE["op_membership_expand"] = cohort(*CONDITIONS_FROM) + members(
    "All Adults (overall)", "bmxbmi IS NOT NULL", "seqn"
)
ORACLE["op_cte_reuse"] = cohort("insurance") + f"""
SELECT 'coverage' AS report, {COVERED} AS label, count(*) AS n FROM cohort GROUP BY 2
UNION ALL SELECT 'gender', {GENDER}, count(*) FROM cohort GROUP BY 2
UNION ALL SELECT 'all', 'all', count(*) FROM cohort"""
ORACLE["op_topn"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"""
ORACLE["op_pinned_order"] = cohort(*CONDITIONS_FROM, "insurance") + f"""
SELECT *, (row_number() OVER (ORDER BY condition <> 'Overall Respondents', condition,
    insurance_status))::INTEGER AS position
FROM (SELECT condition, {COVERED} AS insurance_status, count(*) AS n
    FROM ({members('Overall Respondents', 'true', 'hiq011')}) GROUP BY 1, 2)"""
ORACLE["op_rank_order"] = cohort(*CONDITIONS_FROM) + f"""
SELECT condition, n, (row_number() OVER (ORDER BY list_position(
    ['All Adults (overall)', 'Obesity', 'Diabetes', 'Hypertension', 'High Cholesterol'],
    condition)))::INTEGER AS position
FROM (SELECT condition, count(*) AS n
    FROM ({members('All Adults (overall)', 'bmxbmi IS NOT NULL', 'seqn')}) GROUP BY condition)"""
ORACLE["op_hidden_key_order"] = cohort(*CONDITIONS_FROM) + f"""
SELECT {LEVEL} AS comorbidity_level, count(*) AS n,
    (row_number() OVER (ORDER BY condition_count))::INTEGER AS position
FROM (SELECT {N_PRESENT} AS condition_count FROM cohort) GROUP BY condition_count"""

