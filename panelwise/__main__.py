"""Load landed files into tables, and run studies over them.

    python -m panelwise load LANDING TARGET [--buckets N]
    python -m panelwise report q4_comorbidity TARGET [--database] [--out DIRECTORY]

TARGET is a directory of tables, or a database with --buckets and --database.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from panelwise.plans.studies import SOURCES, STUDIES
from panelwise.session import prepare
from panelwise.sources.load import load_registry, open_bucketed, open_tables


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="panelwise", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="load every registered file")
    load.add_argument("landing")
    load.add_argument("target")
    load.add_argument("--buckets", type=int, help="load into a database, in N buckets by the key")
    load.add_argument("--allow-repeated-key", action="store_true")
    report = commands.add_parser("report", help="run one study")
    report.add_argument("study", choices=STUDIES)
    report.add_argument("target")
    report.add_argument("--database", action="store_true", help="TARGET is a database of bucketed tables")
    report.add_argument("--out", help="write the report as Parquet instead of showing it")
    return parser.parse_args()


def show_all(report: DataFrame) -> None:
    """Print every row; there is one per registered file or report label."""
    report.show(max(1, report.count()), truncate=False)


def main() -> None:
    args = arguments()
    builder = SparkSession.builder.appName("panelwise")
    load = args.command == "load"
    if args.buckets is not None if load else args.database:
        builder = builder.enableHiveSupport()  # databases must outlive the session
    spark = prepare(builder.getOrCreate())
    if load:
        if args.buckets is not None:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {args.target}")
        status = load_registry(
            spark, args.landing, args.target, check_key=not args.allow_repeated_key, buckets=args.buckets
        )
        show_all(status.orderBy("status", "table"))
        return
    report = STUDIES[args.study]((open_bucketed if args.database else open_tables)(spark, args.target, SOURCES))
    if args.out:
        report.write.mode("overwrite").parquet(args.out)
    else:
        show_all(report)


if __name__ == "__main__":
    main()
