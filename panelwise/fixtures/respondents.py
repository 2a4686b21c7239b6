"""Survey-shaped views over the sample `orders` table.

The expressions run unchanged in Spark and in DuckDB. Every order is a
respondent. A view's filter leaves some respondents without a row in that
view, because a missing row is one of the cases the joins must get right; the
base view keeps them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwise.operators.joins import mark_unique

# View -> (rows kept, column -> expression over k and c).
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "demographics": ("k >= 0", {
        "ridageyr": "CAST((k*37+c)%83 AS DOUBLE)",
        "riagendr": "CASE WHEN k%101=0 THEN NULL ELSE CAST(1+c%2 AS DOUBLE) END",
        "ridreth3": "CAST(CASE k%5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4"
                    " ELSE 6 END AS DOUBLE)",
        "indfmpir": "CASE WHEN k%11=0 THEN NULL ELSE CAST(c%501 AS DOUBLE)/100 END",
    }),
    "body_measures": ("k%10 <> 3", {
        "bmxbmi": "CASE WHEN k%17=0 THEN NULL"
                  " ELSE CAST(1500+(k*13+c*7)%3000 AS DOUBLE)/100 END",
    }),
    "diabetes": ("k%12 <> 5", {
        "diq010": "CAST(CASE (k*3+c)%10 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7"
                  " WHEN 4 THEN 9 WHEN 5 THEN NULL ELSE 2 END AS DOUBLE)",
    }),
    "bp_cholesterol_q": ("k%9 <> 2", {
        "bpq020": "CAST(CASE WHEN (k*5+c*3)%10 < 4 THEN 1 WHEN (k*5+c*3)%10 = 4 THEN 7"
                  " WHEN (k*5+c*3)%10 = 5 THEN 9 WHEN (k*5+c*3)%10 = 6 THEN NULL"
                  " ELSE 2 END AS DOUBLE)",
        "bpq080": "CAST(CASE WHEN (k*7+c)%10 < 3 THEN 1 WHEN (k*7+c)%10 = 3 THEN 7"
                  " WHEN (k*7+c)%10 = 4 THEN 9 WHEN (k*7+c)%10 = 5 THEN NULL"
                  " ELSE 2 END AS DOUBLE)",
    }),
    "insurance": ("k%14 <> 6", {
        "hiq011": "CAST(CASE WHEN (k+c*3)%20 < 2 THEN 2 WHEN (k+c*3)%20 = 2 THEN 7"
                  " WHEN (k+c*3)%20 = 3 THEN 9 WHEN (k+c*3)%20 = 4 THEN NULL"
                  " ELSE 1 END AS DOUBLE)",
    }),
    "healthcare_util": ("k%25 <> 4", {
        "huq010": "CAST(CASE WHEN (k*11+c)%13 < 10 THEN 1+((k*11+c)%13)%5"
                  " WHEN (k*11+c)%13 = 10 THEN 7 WHEN (k*11+c)%13 = 11 THEN 9 END AS DOUBLE)",
        "huq030": "CAST(CASE WHEN (k+c*7)%12 < 2 THEN 2 WHEN (k+c*7)%12 = 2 THEN 3"
                  " WHEN (k+c*7)%12 = 3 THEN 7 WHEN (k+c*7)%12 = 4 THEN 9 ELSE 1 END AS DOUBLE)",
        "huq042": "CAST(CASE WHEN (k*3+c*5)%8 < 5 THEN 1+(k*3+c*5)%8"
                  " WHEN (k*3+c*5)%8 = 7 THEN NULL ELSE 1 END AS DOUBLE)",
        "huq055": "CAST(CASE WHEN (k*13+c*3)%7 < 2 THEN 1 WHEN (k*13+c*3)%7 = 2 THEN 9"
                  " WHEN (k*13+c*3)%7 = 3 THEN NULL ELSE 2 END AS DOUBLE)",
        "huq090": "CAST(CASE WHEN (k*17+c)%11 < 2 THEN 1 WHEN (k*17+c)%11 = 2 THEN 7"
                  " ELSE 2 END AS DOUBLE)",
    }),
    "weight_history": ("k%8 <> 1", {
        "whq070": "CAST(CASE WHEN (k*19+c)%9 < 3 THEN 1 WHEN (k*19+c)%9 = 3 THEN 7"
                  " WHEN (k*19+c)%9 = 4 THEN 9 WHEN (k*19+c)%9 = 5 THEN NULL"
                  " ELSE 2 END AS DOUBLE)",
    }),
    "dietary_total_day1": ("k%6 <> 0", {
        "drqsdiet": "CAST(CASE WHEN (k*23+c)%9 < 2 THEN 1 WHEN (k*23+c)%9 = 3 THEN 9"
                    " WHEN (k*23+c)%9 = 5 THEN NULL ELSE 2 END AS DOUBLE)",
    }),
    "medications": ("k%7 <> 5", {
        "rxq033": "CAST(CASE WHEN (k*29+c)%10 < 5 THEN 1 WHEN (k*29+c)%10 = 5 THEN 7"
                  " WHEN (k*29+c)%10 = 6 THEN 9 ELSE 2 END AS DOUBLE)",
        "rxq050": "CASE WHEN (k*29+c)%10 < 5 THEN CAST(1+(k*31+c)%8 AS DOUBLE) END",
    }),
}


def respondent_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The survey tables as the loader would leave them: integer key, coded doubles."""
    # A given schema saves the job that would infer it.
    known = spark.read.schema("o_orderkey bigint, o_custkey bigint")
    orders = known.parquet(f"{sf_dir}/orders.parquet").toDF("k", "c")
    return {
        name: mark_unique(
            orders.filter(kept).selectExpr(
                "CAST(CAST(k AS DOUBLE) AS BIGINT) AS seqn",
                *[f"{expression} AS {column}" for column, expression in columns.items()],
            ),
            "seqn",
        )
        for name, (kept, columns) in VIEWS.items()
    }


def view_sql(name: str) -> str:
    """The same view as a SELECT over `orders`."""
    kept, columns = VIEWS[name]
    shown = ", ".join(f"{expression} AS {column}" for column, expression in columns.items())
    source = "(SELECT o_orderkey AS k, o_custkey AS c FROM orders)"
    return (
        f"SELECT CAST(CAST(k AS DOUBLE) AS BIGINT) AS seqn, {shown} FROM {source} WHERE {kept}"
    )
