"""Repeated keys of stored tables, found with the ranges in the files' footers.

The row groups of Parquet files carry the least and the greatest key. Where the
range of a group meets no other range, a repeated key can only be inside the
group; where ranges meet, only the keys in the common part can repeat across
groups. So each task counts the keys of its own groups, and only keys of common
parts are shuffled: none of a table sorted by its key, all of a table in random
order, which is then checked as if there were no ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from panelwise.operators.joins import assert_unique_key, duplicate_keys, raise_repeated
from panelwise.sources.files import resolve

RANGES = "path string, number int, low bigint, high bigint"
#: A file with more row groups than this is split between tasks.
GROUPS_A_TASK = 16


def key_ranges(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame:
    """path, number, low and high of every row group that holds a key, from footers alone.

    A group without statistics has null bounds. Keys are whole numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = resolve(path)
                with system.open_input_file(place) as handle:
                    footer = pq.ParquetFile(handle).metadata
                at = [footer.schema.column(i).path for i in range(footer.num_columns)].index(key)
                rows = []
                for number in range(footer.num_row_groups):
                    group = footer.row_group(number).column(at)
                    told = group.statistics
                    if told is not None and told.has_min_max:
                        rows.append((path, number, int(told.min), int(told.max)))
                    elif told is None or told.null_count != group.num_values:
                        rows.append((path, number, None, None))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "number", "low", "high"]
                )

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(read, RANGES)


def shared_parts(ranges: Sequence[tuple]) -> list[tuple]:
    """Per row group (path, number, up_to, down_from): keys from `up_to` down or `down_from` up may be elsewhere, too.

    None stands for nothing shared on that side. A group of unknown range may
    share every key with any other.
    """
    if any(low is None for _, _, low, _ in ranges):
        return [(path, number, 2**63 - 1, None) for path, number, _, _ in ranges]
    ordered = sorted(ranges, key=lambda r: (r[2], r[3]))
    before, out = None, []
    for i, (path, number, low, high) in enumerate(ordered):
        after = ordered[i + 1][2] if i + 1 < len(ordered) else None
        up_to = before if before is not None and before >= low else None
        out.append((path, number, up_to, after if after is not None and after <= high else None))
        before = high if before is None else max(before, high)
    return out


def counted_keys(spark: SparkSession, parts: Sequence[tuple], key: str) -> DataFrame:
    """k, n and shared: keys that repeat inside a group, and all keys that other groups may hold."""
    # A group's keys are counted at once; a task takes a few groups of one file, one after the other.
    tasks: dict[tuple, list] = {}
    for path, number, up_to, down_from in sorted(parts, key=lambda p: p[:2]):
        tasks.setdefault((path, number // GROUPS_A_TASK), []).append((number, up_to, down_from))
    rows = [(path, groups) for (path, _), groups in tasks.items()]
    asked = spark.createDataFrame(rows, "path string, groups array<struct<number: int, up_to: bigint, down_from: bigint>>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = resolve(row["path"])
                with system.open_input_file(place) as handle:
                    file = pq.ParquetFile(handle)
                    for group in row["groups"]:
                        column = file.read_row_group(group["number"], columns=[key]).column(0).combine_chunks()
                        values = column.drop_null().cast(pa.int64()).to_numpy(zero_copy_only=False)
                        keys, times = np.unique(values, return_counts=True)
                        shared = np.zeros(len(keys), bool)
                        if group["up_to"] is not None:
                            shared |= keys <= group["up_to"]
                        if group["down_from"] is not None:
                            shared |= keys >= group["down_from"]
                        kept = shared | (times > 1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[kept]), pa.array(times[kept].astype(np.int64)), pa.array(shared[kept])],
                            ["k", "n", "shared"],
                        )

    return asked.mapInArrow(count, "k bigint, n bigint, shared boolean")


def duplicate_stored_keys(df: DataFrame, key: str) -> DataFrame:
    """`duplicate_keys` of a stored Parquet table, its key a whole number.

    The table is one that was read from files and not changed since; its files
    are named by the driver, as for any scan. A table of anything else, with
    another kind of key, or in a store that only Spark can read, is counted by
    `duplicate_keys`.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    paths = df.inputFiles()
    if not isinstance(kind, IntegralType) or not paths or not _reachable(paths[0]):
        return duplicate_keys(df, key)
    ranges = [tuple(r) for r in key_ranges(spark, paths, key).collect()]
    parts = shared_parts(ranges)
    if not parts:
        return duplicate_keys(df.limit(0), key)
    counted = counted_keys(spark, parts, key)
    name = F.col("k").cast(kind).alias(key)
    inside = counted.where("NOT shared").select(name, F.col("n").alias("n_rows"))
    if all(up_to is None and down_from is None for _, _, up_to, down_from in parts):
        return inside
    across = counted.where("shared").groupBy("k").agg(F.sum("n").alias("n_rows")).where("n_rows > 1")
    return inside.unionAll(across.select(name, "n_rows"))


def _reachable(path: str) -> bool:
    try:
        resolve(path)
    except pa.ArrowInvalid:
        return False
    return True


def assert_unique_stored(df: DataFrame, key: str) -> DataFrame:
    """`assert_unique_key` of a stored table."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        return assert_unique_key(df, key)
    raise_repeated(duplicate_stored_keys(df, key), key)
    return df
