"""Small helpers the operators share: tables on shared storage, Arrow batches, worker state."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.session import prepare, scratch_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again.

    Cuts the lineage: what is read does not change when an executor is lost.
    """
    return stored_at(df, purpose)[0]


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """`stored`, and the folder, for rows that are no longer needed at some time."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@dataclass(frozen=True)
class BucketedTable:
    """Rows stored in the shared folder, bucketed by a key: joins on it do not move them again."""

    rows: DataFrame
    name: str
    path: str

    def drop(self) -> None:
        """Remove the table and its files, through whatever file system holds them."""
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(spark, self.path)


def bucketed_table(df: DataFrame, key: str, purpose: str) -> BucketedTable:
    spark = df.sparkSession
    name = f"{purpose}_{uuid.uuid4().hex}".replace("-", "_")
    path = scratch_dir(spark, purpose)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(name)
    return BucketedTable(spark.table(name), name, path)


def bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by a key."""
    return bucketed_table(df, key, purpose).rows


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder, where Spark can reach it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def by_position(df: DataFrame, prefix: str = "given") -> tuple[DataFrame, list]:
    """The rows with columns named by their place, which clash with none of an operator's own, and the way back."""
    named = [f"{prefix}_{i}" for i in range(len(df.columns))]
    return df.toDF(*named), [F.col(n).alias(c) for n, c in zip(named, df.columns, strict=True)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_column(docs: DataFrame, name: str):
    """The text with null as the empty text."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def buckets_of(spark: SparkSession, times: int = 4) -> int:
    """Buckets for rows that Python packs together: a multiple of the session's shuffle partitions.

    Whoever sets that number to fit the data thereby bounds what a bucket holds.
    """
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_worker(name: str, make: Callable):
    """A value that lives as long as the Python worker, made at its first use."""
    home = sys.modules.setdefault("_panelwise_worker", types.ModuleType("_panelwise_worker"))
    if name not in home.__dict__:
        home.__dict__[name] = make()
    return home.__dict__[name]


def trim() -> None:
    """Give memory that a large block used back to the system, so that idle workers hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back is not None:
        give_back(0)


def share(spark: SparkSession, value) -> Callable:
    """A function that gives tasks a value of this package's classes, unpacked once per worker."""
    held, name = spark.sparkContext.broadcast(cloudpickle.dumps(value)), f"shared-{uuid.uuid4().hex}"

    def get():
        home = sys.modules.get("_panelwise_worker")
        if home is not None and name not in home.__dict__:  # a worker serves one value at a time
            for old in [k for k in home.__dict__ if k.startswith("shared-")]:
                del home.__dict__[old]
        return per_worker(name, lambda: cloudpickle.loads(held.value))

    return get


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes of one text column, a long text alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def pack_batch(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes, to travel as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(3).compress(sink.getvalue())


def unpack_batch(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of any types as compressed bytes."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(3).compress(head + body)


def unpack_arrays(packed: bytes, *types_: str) -> list[np.ndarray]:
    """What pack_arrays packed; the types in the same order."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    lengths = np.frombuffer(raw, np.int64, len(types_))
    out, at = [], 8 * len(types_)
    for n, kind in zip(lengths.tolist(), types_, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all elements of the ranges [start, start + length), range after range."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
