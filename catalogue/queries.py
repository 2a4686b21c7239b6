"""One query per study and per operator, each `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.fixtures.respondents import respondent_views
from panelwise.fixtures.transport_files import write_transport
from panelwise.functions.codes import (
    AGE_BINS,
    COMORBIDITY_LEVELS,
    CONDITIONS,
    DIABETES,
    GENDERS,
    OBESITY,
    OTHER_AGE,
    OTHER_GENDER,
    OVERWEIGHT_RANGE,
    PRESCRIPTION,
    answered_flag,
    present_flag,
)
from panelwise.functions.flags import bins, count_flags, decode, flag
from panelwise.functions.measures import (
    aggregate,
    count_where,
    finish,
    mean,
    partial,
    percent,
    row_count,
    total,
    total_where,
)
from panelwise.operators.joins import duplicate_keys, mark_unique, sketch_hottest, star_left_join
from panelwise.operators.key_ranges import duplicate_stored_keys
from panelwise.operators.membership import aggregate_membership, expand_membership
from panelwise.operators.ordering import label_rank, order_by_hidden, pinned_first
from panelwise.operators.totals import stack_measures, with_overall
from panelwise.plans.cohort import KEY, adults, build_cohort
from panelwise.plans.studies import (
    ALL_ADULTS,
    ALL_RESPONDENTS,
    CARE_ANSWERS,
    CONDITION_ANSWERS,
    COVERAGE_ANSWER,
    DRUG_ANSWERS,
    STUDIES,
    comorbidity_level,
    condition_count,
    condition_groups,
    enough_answers,
    insurance_status,
    no_usual_place,
    takes_any_drug,
    takes_at_least,
    used_telehealth,
)
from panelwise.session import prepare, scratch_dir
from panelwise.sources.guard import is_error_page, text_head
from panelwise.sources.files import discard
from panelwise.sources.load import load_registry, lowercase_columns, replace_table
from panelwise.sources.registry import Entry, registry
from panelwise.sources.store import FileStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BODY = {"body_measures": ["bmxbmi"]}
CARE = {"healthcare_util": ["huq010", "huq030", "huq042", "huq055"]}

# The sample tables.
SAMPLE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
SAMPLE_REGISTRY = tuple(Entry(f"{t}.parquet", t, f"sample table {t}") for t in SAMPLE_TABLES)


def over_tables(query: Query) -> Query:
    """Register a query over the sample tables."""
    QUERIES[query.__name__] = query
    return query


def over_respondents(query: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    """Register a query over the respondent views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(respondent_views(prepare(spark), sf_dir))

    QUERIES[query.__name__] = run
    return run


for study in STUDIES.values():
    over_respondents(study)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(report: DataFrame, *order) -> DataFrame:
    """Show the report order as a column. Reports have one row per label, a handful."""
    return report.withColumn("position", F.row_number().over(Window.orderBy(*order)))


# Sources, sinks, ingest


@over_tables
def op_project_alias(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("price"),
        F.lit("order").alias("kind"),
    )


@over_tables
def op_lowercase_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return lowercase_columns(orders.toDF(*[c.upper() for c in orders.columns]))


@over_tables
def op_replace_sink(spark, sf_dir):
    path = f"{scratch_dir(prepare(spark), 'replace')}/orders"
    replace_table(table(spark, sf_dir, "region"), path)
    replace_table(table(spark, sf_dir, "orders"), path)
    return spark.read.parquet(path)


@over_tables
def op_versioned_replace(spark, sf_dir):
    """Two tables replaced in one step, twice; the set in force is read back."""
    store = FileStore(prepare(spark), scratch_dir(spark, "versions"))
    store.replace({"orders": table(spark, sf_dir, "region"), "lineitem": table(spark, sf_dir, "nation")})
    store.replace({t: table(spark, sf_dir, t) for t in ("orders", "lineitem")})
    now = store.open_all(["orders", "lineitem"])
    lines = now["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    joined = now["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_totalprice", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@over_tables
def op_snapshot_scan(spark, sf_dir):
    """What a reader sees that opened its tables before they were replaced."""
    store = FileStore(prepare(spark), scratch_dir(spark, "snapshot"))
    store.replace({t: table(spark, sf_dir, t) for t in ("nation", "region")})
    held = store.open_all(["nation", "region"])
    store.replace({t: table(spark, sf_dir, t).limit(0) for t in ("nation", "region")})
    return held["nation"].join(held["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@over_tables
def op_load_resume(spark, sf_dir):
    """A load that takes up one that never ended: what that had completed is not read again."""
    target = scratch_dir(prepare(spark), "resume")
    started, rest = SAMPLE_REGISTRY[:5], SAMPLE_REGISTRY
    load_registry(spark, sf_dir, target, started, source="parquet", key=None)
    store = FileStore(spark, target)
    done = store.versions.current().tables
    unfinished = store.versions.begin()
    for name, record in done.items():
        unfinished.completed(name, record)
    status = load_registry(spark, sf_dir, target, rest, source="parquet", key=None)
    now = store.versions.current().tables
    kept = [(t, t in done and now[t]["version"] == done[t]["version"]) for t in now]
    discard(target)
    return status.join(spark.createDataFrame(kept, "table string, resumed boolean"), "table").select("table", "rows", "resumed")


@over_tables
def op_load_counts(spark, sf_dir):
    target = scratch_dir(prepare(spark), "load")
    status = load_registry(spark, sf_dir, target, SAMPLE_REGISTRY, source="parquet", key=None)
    discard(target)
    return status.select("table", "rows")


@over_tables
def op_load_status(spark, sf_dir):
    target = scratch_dir(prepare(spark), "load")
    entries = (*SAMPLE_REGISTRY, Entry("absent.parquet", "absent", "never landed"))
    status = load_registry(spark, sf_dir, target, entries, source="parquet", key=None)
    discard(target)
    return status


@over_tables
def op_registry_join(spark, sf_dir):
    status = load_registry(prepare(spark), sf_dir, None, SAMPLE_REGISTRY, source="parquet", key=None)
    described = registry(spark, SAMPLE_REGISTRY)
    return described.join(status.select("table", "status", "rows"), "table", "left")


@over_tables
def op_error_page_guard(spark, sf_dir):
    head = text_head(F.col("html"))
    marks = ("<!DOCTYPE html", 'lang="es"')
    return table(spark, sf_dir, "pages").select(
        "page_id", flag(is_error_page(head, marks)).alias("is_error_page")
    )


@over_tables
def op_xport_roundtrip(spark, sf_dir):
    given = table(spark, sf_dir, "orders")
    orders = given.select(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("odate"),
        F.col("o_orderkey").cast("double").alias("okey"),
        F.col("o_custkey").cast("double").alias("ckey"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    path = f"{scratch_dir(spark, 'xport')}/orders"
    write_transport(orders, path)
    back = lowercase_columns(spark.read.format("xport").load(path))
    return back.select(
        F.col("okey").cast("bigint").alias("o_orderkey"),
        F.col("ckey").cast("bigint").alias("o_custkey"),
        F.col("price").alias("o_totalprice"),
        F.timestamp_micros(F.col("odate").cast("bigint")).cast(given.schema["o_orderdate"].dataType).alias("o_orderdate"),
        F.col("status").alias("o_orderstatus"),
        F.col("priority").alias("o_orderpriority"),
    )


@over_tables
def op_xport_columns(spark, sf_dir):
    """Two of the columns of transport files, the others not decoded."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("double").alias("okey"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("ckey"),
        F.col("o_orderpriority").alias("priority"),
    )
    path = f"{scratch_dir(spark, 'xport')}/orders"
    write_transport(orders, path)
    some = lowercase_columns(spark.read.format("xport").option("columns", "priority,okey").load(path))
    return some.select(F.col("okey").cast("bigint").alias("o_orderkey"), F.col("priority").alias("o_orderpriority"))


# Projections and scalar expressions


@over_respondents
def op_threshold_flag(tables):
    return build_cohort(tables, BODY | DRUG_ANSWERS).select(
        KEY,
        present_flag(OBESITY).alias("is_obese"),
        takes_at_least(3).alias("is_polypharmacy"),
        takes_at_least(5).alias("is_high_polypharmacy"),
    )


@over_respondents
def op_range_flag(tables):
    return build_cohort(tables, BODY).select(
        KEY, flag(F.col("bmxbmi").between(*OVERWEIGHT_RANGE)).alias("is_overweight")
    )


@over_respondents
def op_inlist_flag(tables):
    return build_cohort(tables, {"diabetes": ["diq010"]}).select(
        KEY, present_flag(DIABETES).alias("has_diabetes")
    )


@over_respondents
def op_equality_flag(tables):
    return build_cohort(tables, CARE).select(
        KEY,
        no_usual_place().alias("no_usual_care_place"),
        used_telehealth().alias("had_telehealth"),
    )


@over_respondents
def op_valid_flags(tables):
    names = ["has_bmi_data", "has_diabetes_data", "has_bp_data", "has_chol_data"]
    flags = [
        answered_flag(c).alias(n) for c, n in zip(CONDITIONS.values(), names, strict=True)
    ]
    return build_cohort(tables, CONDITION_ANSWERS).select(KEY, *flags)


@over_respondents
def op_flag_count(tables):
    return build_cohort(tables, CONDITION_ANSWERS).select(
        KEY,
        count_flags([answered_flag(c) for c in CONDITIONS.values()]).alias("n_answered"),
        condition_count().alias("condition_count"),
    )


@over_respondents
def op_two_way_label(tables):
    return build_cohort(tables, COVERAGE_ANSWER).select(
        KEY, insurance_status().alias("insurance_status")
    )


@over_respondents
def op_code_decode(tables):
    return tables["demographics"].select(
        KEY, decode(F.col("riagendr"), GENDERS, OTHER_GENDER).alias("gender")
    )


@over_respondents
def op_bins(tables):
    return tables["demographics"].select(
        KEY, bins(F.col("ridageyr"), AGE_BINS, OTHER_AGE).alias("age_group")
    )


@over_respondents
def op_simple_case_label(tables):
    counted = build_cohort(tables, CONDITION_ANSWERS).select(
        condition_count().alias("condition_count")
    )
    report = aggregate(counted, ["condition_count"], [row_count("n")])
    return report.select(
        "condition_count",
        decode(F.col("condition_count"), COMORBIDITY_LEVELS).alias("comorbidity_level"),
        decode(F.col("condition_count"), {0: "none"}).alias("only_zero_labelled"),
        "n",
    )


@over_respondents
def op_round(tables):
    return build_cohort(tables, BODY, columns=["indfmpir"]).select(
        KEY,
        F.round("indfmpir", 1).alias("income_1"),
        F.round(F.col("bmxbmi") / 7, 2).alias("bmi_2"),
    )


@over_respondents
def op_mean_float(tables):
    cohort = build_cohort(tables, CARE, columns=["ridreth3"])
    return aggregate(cohort, ["ridreth3"], [mean("avg_health_score", F.col("huq010"))])


@over_respondents
def op_cond_mean(tables):
    cohort = build_cohort(tables, DRUG_ANSWERS, columns=["ridreth3"])
    on_drugs = takes_any_drug() == 1
    return aggregate(
        cohort, ["ridreth3"], [mean("avg_rx_count", F.col("rxq050"), where=on_drugs)]
    )


# Filters


@over_respondents
def op_filter_range(tables):
    return adults(tables, ["ridageyr"])


@over_respondents
def op_filter_not_null(tables):
    measured = F.col("bmxbmi").isNotNull()
    return build_cohort(tables, BODY).filter(measured & (present_flag(OBESITY) == 1))


@over_respondents
def op_completeness_filter(tables):
    return build_cohort(tables, CONDITION_ANSWERS).filter(enough_answers())


# Joins


@over_tables
def op_left_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    per_order = aggregate(
        lines, ["o_orderkey"], [row_count("n_lines"), total("sum_qty", F.col("l_quantity"))]
    )
    return star_left_join(orders, {"lines": mark_unique(per_order, "o_orderkey")}, "o_orderkey")


@over_respondents
def op_left_join_star(tables):
    return build_cohort(
        tables, CONDITION_ANSWERS | COVERAGE_ANSWER | CARE_ANSWERS, columns=["ridageyr"]
    )


@over_respondents
def op_filtered_outer_join(tables):
    return build_cohort(tables, DRUG_ANSWERS, required={"medications": PRESCRIPTION.answered()})


@over_respondents
def op_unused_join_prune(tables):
    # Insurance brings no column, so it is not joined at all.
    return build_cohort(tables, {"insurance": [], "weight_history": ["whq070"]})


@over_tables
def op_unique_key_check(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@over_tables
def op_key_ranges(spark, sf_dir):
    """The same keys by the ranges in the footers: only those of common parts are shuffled."""
    return duplicate_stored_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


@over_tables
def op_sketched_left_join(spark, sf_dir):
    """A table of repeated keys, none of them hot as a sketch of its keys shows: one left join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return star_left_join(orders, {"lines": sketch_hottest(lines, "o_orderkey")}, "o_orderkey")


# Aggregations


@over_tables
def op_global_agg(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return aggregate(
        lines,
        [],
        [
            row_count("n"),
            total("sum_qty", F.col("l_quantity")),
            count_where("n_returned", F.col("l_returnflag") == "R"),
        ],
    )


@over_tables
def op_group_one(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return aggregate(
        lines, ["l_returnflag"], [row_count("n"), total("sum_qty", F.col("l_quantity"))]
    )


@over_tables
def op_group_two(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return aggregate(
        lines,
        ["l_returnflag", "l_linestatus"],
        [row_count("n"), mean("avg_qty", F.col("l_quantity"))],
    )


@over_tables
def op_sum_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return aggregate(
        orders,
        ["o_orderpriority"],
        [
            total("n_finished", flag(F.col("o_orderstatus") == "F")),
            total("n_large", flag(F.col("o_totalprice") >= 100000)),
        ],
    )


@over_tables
def op_cond_sum(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    large = flag(F.col("o_totalprice") >= 100000)
    return aggregate(
        orders,
        ["o_orderpriority"],
        [
            total_where("large_finished", F.col("o_orderstatus") == "F", large),
            total_where("large_open", F.col("o_orderstatus") == "O", large),
        ],
    )


@over_tables
def op_cond_count(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return aggregate(
        lines,
        ["l_linestatus"],
        [
            count_where("n_mid_qty", F.col("l_quantity").between(10, 20)),
            count_where("n_discounted", F.col("l_discount").isNotNull()),
        ],
    )


@over_respondents
def op_pct_count(tables):
    cohort = build_cohort(tables, CARE, columns=["ridreth3"])
    return aggregate(cohort, ["ridreth3"], [percent("pct_no_usual_care", no_usual_place())])


@over_respondents
def op_pct_valid(tables):
    cohort = build_cohort(tables, {"diabetes": ["diq010"]}, columns=["ridreth3"])
    share = percent("pct_diabetes", present_flag(DIABETES), among=DIABETES.answered())
    return aggregate(cohort, ["ridreth3"], [share])


@over_respondents
def op_pct_answered(tables):
    cohort = build_cohort(tables, {"weight_history": ["whq070"]}, columns=["ridreth3"])
    answer = F.col("whq070")
    share = percent("pct_lose_weight", flag(answer == 1), among=answer.isNotNull())
    return aggregate(cohort, ["ridreth3"], [share])


@over_respondents
def op_detail_plus_overall(tables):
    cohort = build_cohort(tables, CARE, columns=["riagendr"]).withColumn(
        "gender", decode(F.col("riagendr"), GENDERS, OTHER_GENDER)
    )
    measures = [row_count("n"), percent("pct_used_telehealth", used_telehealth())]
    return with_overall(cohort, ["gender"], measures, "OVERALL")


# Set operations, subqueries, ordering, limits


@over_respondents
def op_union_all_measures(tables):
    cohort = build_cohort(tables, CONDITION_ANSWERS)
    rows = {
        label: [
            count_where("n_answered", c.answered()).direct(),
            total("n_present", present_flag(c)).direct(),
        ]
        for label, c in CONDITIONS.items()
    }
    return stack_measures(cohort, rows, "condition", ["n_answered", "n_present"])


@over_respondents
def op_membership_expand(tables):
    cohort = build_cohort(tables, CONDITION_ANSWERS)
    groups = {ALL_ADULTS: OBESITY.answered(), **condition_groups()}
    return expand_membership(cohort, groups, "condition").select(KEY, "condition")


@over_respondents
def op_cte_reuse(tables):
    """Three reports from one cohort, which is read and joined once."""
    cohort = build_cohort(tables, COVERAGE_ANSWER, columns=["riagendr"]).select(
        insurance_status().alias("insurance_status"),
        decode(F.col("riagendr"), GENDERS, OTHER_GENDER).alias("gender"),
    )
    measures = [row_count("n")]
    sums = partial(cohort, ["insurance_status", "gender"], measures)

    def report(view: str, keys: list[str], shown) -> DataFrame:
        return finish(sums, keys, measures).select(
            F.lit(view).alias("report"), shown.alias("label"), "n"
        )

    return (
        report("coverage", ["insurance_status"], F.col("insurance_status"))
        .unionByName(report("gender", ["gender"], F.col("gender")))
        .unionByName(report("all", [], F.lit("all")))
    )


@over_tables
def op_topn(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return (
        orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(100)
    )


@over_respondents
def op_pinned_order(tables):
    cohort = build_cohort(tables, CONDITION_ANSWERS | COVERAGE_ANSWER).withColumn(
        "insurance_status", insurance_status()
    )
    groups = {ALL_RESPONDENTS: F.lit(True), **condition_groups()}
    report = aggregate_membership(
        cohort, groups, "condition", ["insurance_status"], [row_count("n")]
    )
    order = (pinned_first("condition", ALL_RESPONDENTS), "condition", "insurance_status")
    return numbered(report, *order)


@over_respondents
def op_rank_order(tables):
    cohort = build_cohort(tables, CONDITION_ANSWERS)
    groups = {ALL_ADULTS: OBESITY.answered(), **condition_groups()}
    report = aggregate_membership(cohort, groups, "condition", [], [row_count("n")])
    return numbered(report, label_rank("condition", list(groups)))


@over_respondents
def op_hidden_key_order(tables):
    counted = build_cohort(tables, CONDITION_ANSWERS).select(
        condition_count().alias("condition_count")
    )
    report = numbered(
        aggregate(counted, ["condition_count"], [row_count("n")]), "condition_count"
    )
    shown = [comorbidity_level(), F.col("n"), F.col("position")]
    return order_by_hidden(report, "condition_count", shown)


