"""Landed files that are web error pages saved under a data file's name."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from panelwise.sources.files import read_range, resolve

# How much of a file is looked at, and what betrays an error page.
HEAD_BYTES = 1024
ERROR_MARKS = ("<!DOCTYPE html", "Page Not Found")


def is_error_page(head: Column, marks: Sequence[str] = ERROR_MARKS) -> Column:
    """True when the head, a binary column, holds every mark. A null head is no error page."""
    found = [F.contains(head, F.lit(m.encode())) for m in marks]
    return F.coalesce(reduce(and_, found), F.lit(False))


def text_head(text: Column) -> Column:
    """The bytes of a text column that the guard looks at."""
    return F.substring(F.encode(text, "UTF-8"), 1, HEAD_BYTES)


@F.pandas_udf(BinaryType())
def file_head(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """First bytes of each file without its invalid UTF-8; null when unreadable."""

    def head(uri: str) -> bytes | None:
        try:
            system, path = resolve(uri)
            with system.open_input_file(path) as handle:
                return read_range(handle, 0, HEAD_BYTES).decode("utf-8", "ignore").encode()
        except OSError:
            return None

    for batch in paths:
        yield batch.map(head)


def landed_files(spark: SparkSession, *uris: str) -> DataFrame:
    """Path, size, time and error-page mark of landed files.

    Only the listing, subfolders included, and the head of each file are read, never its content.
    Files without a single byte are not listed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(uris))
    listed = listed.select("path", "length", "modificationTime")
    return listed.withColumn("is_error_page", is_error_page(file_head("path")))
