"""Spark source for statistical transport files: `spark.read.format("xport")`.

A file is cut into byte ranges, each read by its own task, so one huge file
and many small ones both spread over the cluster. The format is the published
version 5 layout: 80-byte header cards, 140-byte column descriptors, then
fixed-width records with IBM hexadecimal floating-point numbers.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelwise.sources.files import read_range, resolve

# The published file layout.
CARD = 80
LIBRARY_CARD = b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!"
MEMBER_CARD = b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!"
NAMES_CARD = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
ROWS_CARD = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
HEADER_CARDS = 8
DESCRIPTOR_SIZES = (b"140", b"136")
MISSING_MARKS = b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRAILING_BLANKS = " \t\n\r\x0b\x0c\x00"
NUMERIC, TEXT = 1, 2
WIDTHS = {NUMERIC: range(2, 9), TEXT: range(1, 1 << 15)}

DEFAULT_RANGE = 64 << 20
BATCH_BYTES = 8 << 20


class TransportFormatError(ValueError):
    """The file is not a readable transport file."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: int
    width: int
    start: int


@dataclass(frozen=True)
class Layout:
    """Where the records of a file begin, how wide they are, what they hold."""

    fields: tuple[Field, ...]
    data_start: int
    width: int

    def schema(self) -> StructType:
        kinds = {NUMERIC: DoubleType(), TEXT: StringType()}
        return StructType([StructField(f.name, kinds[f.kind], True) for f in self.fields])

    def only(self, columns: Sequence[str] | None, name: str) -> Layout:
        """The layout with these columns alone, in this order, by names of any case; the records stay as wide."""
        if columns is None:
            return self
        known = {f.name.lower(): f for f in self.fields}
        absent = [c for c in columns if c.lower() not in known]
        if absent or not columns:
            raise TransportFormatError(f"{name}: no column {', '.join(absent) or 'is asked for'}")
        return Layout(tuple(known[c.lower()] for c in columns), self.data_start, self.width)


def read_layout(handle, name: str) -> Layout:
    """Parse the header cards and column descriptors of an open file."""
    head = read_range(handle, 0, HEADER_CARDS * CARD)
    names_card = head[7 * CARD:]
    if not (
        head.startswith(LIBRARY_CARD)
        and head[3 * CARD:].startswith(MEMBER_CARD)
        and names_card.startswith(NAMES_CARD)
    ):
        raise TransportFormatError(f"{name}: not a transport file")
    counted, sized = names_card[54:58], head[3 * CARD + 75:3 * CARD + 78]
    if not counted.isdigit() or sized not in DESCRIPTOR_SIZES:
        raise TransportFormatError(f"{name}: damaged header")
    count, size = int(counted), int(sized)
    block = -(-count * size // CARD) * CARD
    described = read_range(handle, HEADER_CARDS * CARD, block + CARD)
    if not described[block:].startswith(ROWS_CARD):
        raise TransportFormatError(f"{name}: no record header after {count} columns")
    fields = tuple(_field(described[i * size:(i + 1) * size], name) for i in range(count))
    width = sum(f.width for f in fields)
    if width == 0 or any(f.start < 0 or f.start + f.width > width for f in fields):
        raise TransportFormatError(f"{name}: columns do not fit a record of {width} bytes")
    return Layout(fields, HEADER_CARDS * CARD + block + CARD, width)


def _field(raw: bytes, name: str) -> Field:
    kind, _, width = struct.unpack_from(">hhh", raw, 0)
    (start,) = struct.unpack_from(">i", raw, 84)
    column = raw[8:16].decode("ascii", "replace").rstrip()
    if width not in WIDTHS.get(kind, ()) or not column.isascii():
        raise TransportFormatError(f"{name}: column {column} has type {kind}, width {width}")
    return Field(column, kind, width, start)


def holds_card(chunk: bytes, start: int, card: bytes) -> bool:
    """Whether a card, which begins at a multiple of its size, begins in bytes that lie at `start` of the records."""
    at = chunk.find(card)
    while at >= 0 and (start + at) % CARD:
        at = chunk.find(card, at + 1)
    return at >= 0


def record_count(handle, layout: Layout, size: int) -> int:
    """Records in the file, not counting the blank fill of the last card.

    Records narrower than a card can fit wholly into the fill. Only blank ones
    there are dropped: a blank record anywhere else is data.
    """
    body = size - layout.data_start
    count = body // layout.width
    tail_start = max(0, body - (CARD - 1))
    tail = read_range(handle, layout.data_start + tail_start, CARD)
    while count > 0:
        at = (count - 1) * layout.width - tail_start
        if at < 0 or tail[at:at + layout.width].strip(b" "):
            break
        count -= 1
    return count


IS_MISSING_MARK = np.isin(np.arange(256), list(MISSING_MARKS))
# The first byte of a number is its sign and its exponent of 16, which together
# are one factor for the 56-bit fraction. All factors are exact doubles.
FACTOR = np.array([
    (-1.0 if byte & 0x80 else 1.0) * 2.0 ** (4 * ((byte & 0x7F) - 64) - 56)
    for byte in range(256)
])
FRACTION_BITS = np.uint64((1 << 56) - 1)


def decode_numbers(raw: np.ndarray) -> pa.Array:
    """IBM hexadecimal floats, one per row of a byte matrix; missing marks give null."""
    rows, width = raw.shape
    full = np.zeros((rows, 8), dtype=np.uint8)
    full[:, :width] = raw
    fraction = full.view(">u8").reshape(rows).astype(np.uint64) & FRACTION_BITS
    missing = IS_MISSING_MARK[full[:, 0]] & (fraction == 0)
    # A double keeps 53 bits of the 56; longer fractions are cut, not rounded.
    excess = np.zeros(rows, dtype=np.uint64)
    for bits in (53, 54, 55):
        excess += fraction >= np.uint64(1 << bits)
    fraction = fraction >> excess << excess
    return pa.array(fraction.astype(np.float64) * FACTOR[full[:, 0]], mask=missing)


def decode_text(raw: np.ndarray) -> pa.Array:
    """UTF-8 text, one value per row of a byte matrix, without trailing blanks."""
    rows, width = raw.shape
    packed = pa.Array.from_buffers(
        pa.binary(width), rows, [None, pa.py_buffer(np.ascontiguousarray(raw))]
    )
    text = packed.cast(pa.binary()).cast(pa.string())
    return pc.ascii_rtrim(text, characters=TRAILING_BLANKS)


def decode_records(chunk: bytes, layout: Layout) -> pa.RecordBatch:
    """Whole records to an Arrow batch; bytes of columns that the layout does not name are not looked at."""
    matrix = np.frombuffer(chunk, dtype=np.uint8).reshape(-1, layout.width)
    columns = [
        (decode_numbers if f.kind == NUMERIC else decode_text)(
            matrix[:, f.start:f.start + f.width]
        )
        for f in layout.fields
    ]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in layout.fields])


@dataclass
class ByteRanges(InputPartition):
    """What one task reads: (uri, from, to) ranges, several when files are small."""

    ranges: list[tuple[str, int, int]]


def list_files(uris: list[str], extension: str | None) -> list[tuple[str, int]]:
    """(uri, size) of every file named, and of every file with the extension in or below a named directory."""
    found = []
    for uri in uris:
        system, path = resolve(uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            found.append((uri, info.size))
        elif info.type == fs.FileType.Directory:
            for entry in system.get_file_info(fs.FileSelector(path, recursive=True)):
                below = entry.path[len(path.rstrip("/")) :].strip("/")
                hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
                if entry.is_file and not hidden and extension in (None, entry.extension.lower()):
                    found.append((f"{uri.rstrip('/')}/{below}", entry.size))
        else:
            raise FileNotFoundError(f"no such file or directory: {uri}")
    return sorted(found)


class TransportSource(DataSource):
    """Options: the load path or paths, and `rangeBytes` for the size of a task's share.

    `listing` may name the files instead, as JSON pairs of URI and size, by
    whoever has listed them already; nothing is listed again then. `columns`
    names the columns to decode, in that order and separated by commas; those
    left out cost nothing but the reading of the records.
    """

    @classmethod
    def name(cls) -> str:
        return "xport"

    def _uris(self) -> list[str]:
        if "paths" in self.options:
            return json.loads(self.options["paths"])
        if "path" in self.options:
            return [self.options["path"]]
        raise ValueError("xport needs a path")

    def _files(self) -> list[tuple[str, int]]:
        if "listing" in self.options:
            return sorted((uri, size) for uri, size in json.loads(self.options["listing"]))
        return list_files(self._uris(), "xpt")

    def schema(self) -> StructType:
        # Only the header of the first file is read here, on the driver.
        files = self._files()
        if not files:
            raise FileNotFoundError(f"no transport files in {self._uris()}")
        uri = files[0][0]
        system, path = resolve(uri)
        with system.open_input_file(path) as handle:
            return read_layout(handle, uri).only(self._columns(), uri).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        share = int(self.options.get("rangeBytes", DEFAULT_RANGE))
        return TransportReader(self._uris(), schema, share, self._files(), self._columns())

    def _columns(self) -> list[str] | None:
        asked = self.options.get("columns")
        return None if asked is None else [c.strip() for c in asked.split(",") if c.strip()]


class TransportReader(DataSourceReader):
    def __init__(
        self,
        uris: list[str],
        schema: StructType,
        share: int,
        files: list[tuple[str, int]] | None = None,
        columns: list[str] | None = None,
    ) -> None:
        self.files = list_files(uris, "xpt") if files is None else files
        self.columns = columns
        self.schema = schema
        self.share = share

    def partitions(self) -> list[ByteRanges]:
        """Cut large files, pack small ones, by listed sizes alone.

        Tasks read batch by batch, so a share may exceed memory. It is always
        `rangeBytes`; raise it where the driver would have too many to track.
        """
        share = self.share
        packed: list[ByteRanges] = []
        room = 0
        for uri, size in self.files:
            for start in range(0, size, share):
                end = min(size, start + share)
                if end - start > room:
                    packed.append(ByteRanges([]))
                    room = share
                packed[-1].ranges.append((uri, start, end))
                room -= end - start
        return packed

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for uri, start, end in partition.ranges:
            system, path = resolve(uri)
            with system.open_input_file(path) as handle:
                yield from self._read_range(handle, uri, start, end)

    def _read_range(self, handle, uri: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        layout = read_layout(handle, uri).only(self.columns, uri)
        if layout.schema() != self.schema:
            raise TransportFormatError(f"{uri}: columns differ from those of the first file")
        count = record_count(handle, layout, handle.size())
        # A record belongs to the range that holds its first byte.
        first = max(0, -((layout.data_start - start) // layout.width))
        last = min(count, max(0, -((layout.data_start - end) // layout.width)))
        step = max(1, BATCH_BYTES // layout.width)
        for at in range(first, last, step):
            rows = min(step, last - at)
            start, size = at * layout.width, rows * layout.width
            chunk = read_range(handle, layout.data_start + start, size + len(MEMBER_CARD) - 1)
            if holds_card(chunk, start, MEMBER_CARD):
                raise TransportFormatError(f"{uri}: more than one member")
            chunk = chunk[:size]
            try:
                yield decode_records(chunk, layout)
            except pa.ArrowInvalid as e:
                raise TransportFormatError(f"{uri}: text is not UTF-8") from e
