"""Write a DataFrame as transport files, one per task, as input for the source.

Only tests and the round-trip query use this; loads never write the format.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from panelwise.sources.files import resolve
from panelwise.sources.transport import (
    CARD,
    LIBRARY_CARD,
    MEMBER_CARD,
    NAMES_CARD,
    NUMERIC,
    ROWS_CARD,
    TEXT,
)


@dataclass(frozen=True)
class OutField:
    name: str
    kind: int
    width: int


def encode_numbers(values: pa.Array, width: int = 8) -> np.ndarray:
    """Doubles to IBM hexadecimal floats, cut to `width` bytes; null to a missing mark."""
    given = values.cast(pa.float64())
    missing = np.asarray(pc.fill_null(pc.is_nan(given), True))
    numbers = np.where(missing, 0.0, np.asarray(pc.fill_null(given, 0.0)))
    mantissa, exponent = np.frexp(np.abs(numbers))
    sixteens = -(-exponent // 4)
    fraction = np.ldexp(mantissa, exponent - 4 * sixteens + 56).astype(np.uint64)
    bits = fraction | ((sixteens + 64).astype(np.uint64) << np.uint64(56))
    bits |= np.signbit(numbers).astype(np.uint64) << np.uint64(63)
    bits[numbers == 0] = 0
    bits[missing] = ord(".") << 56
    return bits.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]


def encode_text(values: pa.Array, width: int) -> np.ndarray:
    """UTF-8 text filled with blanks; null and empty look the same in a file."""
    raw = pc.fill_null(values.cast(pa.binary()), b"").to_pylist()
    if any(len(v) > width for v in raw):
        raise ValueError(f"text longer than {width} bytes")
    joined = b"".join(v.ljust(width) for v in raw)
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, width)


def encode_batch(batch: pa.RecordBatch, fields: Sequence[OutField]) -> bytes:
    """A batch as fixed-width records."""
    columns = [
        (encode_numbers if f.kind == NUMERIC else encode_text)(batch.column(i), f.width)
        for i, f in enumerate(fields)
    ]
    return np.concatenate(columns, axis=1).tobytes()


def header(fields: Sequence[OutField]) -> bytes:
    """The cards before the first record."""
    stamp = b"01JAN70:00:00:00"

    def card(start: bytes, rest: bytes = b"0" * 30) -> bytes:
        return (start + rest).ljust(CARD)

    member = b"SAS     DATA    SASDATA 9.4     FIXTURE " + b" " * 24 + stamp
    described, start = b"", 0
    for number, f in enumerate(fields, 1):
        name = f.name.upper().encode("ascii")
        if len(name) > 8:
            raise ValueError(f"column name {f.name} is longer than 8 characters")
        described += struct.pack(
            ">hhhh8s40s8shhh2s8shhl52s",
            f.kind, 0, f.width, number, name.ljust(8), b" " * 40, b" " * 8,
            0, 0, 0, b"", b" " * 8, 0, 0, start, b"",
        )
        start += f.width
    described += b" " * (-len(described) % CARD)
    return b"".join([
        card(LIBRARY_CARD),
        card(b"SAS     SAS     SASLIB  9.4     FIXTURE " + b" " * 24 + stamp, b""),
        card(stamp, b""),
        card(MEMBER_CARD, b"000000000000000001600000000140"),
        card(b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!"),
        card(member, b""),
        card(stamp, b""),
        card(NAMES_CARD, b"000000%04d" % len(fields) + b"0" * 20),
        described,
        card(ROWS_CARD),
    ])


@dataclass
class Written(WriterCommitMessage):
    staged: str
    final: str


class TransportFixture(DataSource):
    """Sink `xport_fixture`; option `widths` gives the byte width of text columns."""

    @classmethod
    def name(cls) -> str:
        return "xport_fixture"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        widths = dict(
            part.split(":") for part in self.options.get("widths", "").split(",") if part
        )
        fields = [
            OutField(f.name, TEXT, int(widths[f.name]))
            if isinstance(f.dataType, StringType)
            else OutField(f.name, NUMERIC, int(widths.get(f.name, 8)))
            for f in schema.fields
        ]
        return FixtureWriter(self.options["path"], fields)


class FixtureWriter(DataSourceArrowWriter):
    """Each attempt stages its own file; only committed attempts get a visible name."""

    def __init__(self, uri: str, fields: list[OutField]) -> None:
        self.uri = uri.rstrip("/")
        self.fields = fields

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.xpt"
        staged = f"{self.uri}/_attempt-{task.taskAttemptId()}-{name}"
        system, path = resolve(staged)
        system.create_dir(os.path.dirname(path), recursive=True)
        written = 0
        with system.open_output_stream(path) as out:
            out.write(header(self.fields))
            for batch in iterator:
                data = encode_batch(batch, self.fields)
                out.write(data)
                written += len(data)
            out.write(b" " * (-written % CARD))
        return Written(staged, f"{self.uri}/{name}")

    def commit(self, messages: list[Written]) -> None:
        def publish(message: Written) -> None:
            system, staged = resolve(message.staged)
            system.move(staged, resolve(message.final)[1])

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(publish, messages))

    def abort(self, messages: list[Written]) -> None:
        for message in messages:
            if message is not None:
                system, staged = resolve(message.staged)
                if system.get_file_info(staged).type == fs.FileType.File:
                    system.delete_file(staged)


def write_transport(df: DataFrame, uri: str) -> None:
    """Write `df` to a new directory; text columns are as wide as their longest value."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    widths = ""
    if texts:
        longest = df.agg(
            *[F.greatest(F.lit(1), F.max(F.octet_length(t))).alias(t) for t in texts]
        ).first()
        widths = ",".join(f"{t}:{longest[t]}" for t in texts)
    df.sparkSession.dataSource.register(TransportFixture)
    df.write.format("xport_fixture").option("widths", widths).mode("append").save(uri)
