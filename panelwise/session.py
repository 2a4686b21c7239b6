"""Session matters: settings that pay off at scale, and where to write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import panelwise
from panelwise.sources.transport import TransportSource
from panelwise.sources.versions import Files

# Runtime re-planning merges small shuffle partitions, and splits a join
# partition that holds a hot key, also where that costs one more shuffle
# further up a chain of joins. The last setting lets joins of bucketed tables
# rely on the order inside a bucket, which is one sorted file, instead of
# sorting it again.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}
PREPARED = "panelwise.prepared"
PARTITIONS_A_CORE = 4
#: Folders for written tables that this process has handed out and not removed.
SCRATCH: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Make the transport source known, and apply the settings nobody has set."""
    if spark.conf.get(PREPARED, None) is None:
        wanted = {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions(spark))}
        for name, value in wanted.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)
        # Workers get this package's code with the tasks, installed there or not.
        cloudpickle.register_pickle_by_value(panelwise)
        spark.dataSource.register(TransportSource)
        spark.conf.set(PREPARED, "true")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle starts with, by one rule for local sessions and clusters.

    Four for each core there is or that dynamic allocation may bring. Unneeded
    ones are merged at run time; the number cannot grow there, so for a shuffle
    that would put more than about 200 MB into each, set it higher.
    """
    cores = spark.sparkContext.defaultParallelism
    most = spark.conf.get("spark.dynamicAllocation.maxExecutors", None)
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true" and most and most.isdigit():
        cores = max(cores, int(most) * int(spark.conf.get("spark.executor.cores", "1")))
    return PARTITIONS_A_CORE * cores


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new directory for written tables, in the folder the cluster shares.

    That folder is `spark.checkpoint.dir`. Only a local session that has none
    falls back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    elif is_local(spark):
        path = tempfile.mkdtemp(prefix=f"{purpose}-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession, paths: Sequence[str] | None = None) -> int:
    """Remove scratch folders, all of this process or some, and the catalog tables on them; returns how many went.

    For when every result that was built on them has been written: operators
    store intermediate tables there and their results are read from these.
    """
    gone = [p for p in SCRATCH if paths is None or p in set(paths)]
    if gone:
        for row in spark.sql("SHOW TABLES").collect():
            if not row.isTemporary and any(place in _location(spark, row.tableName) for place in gone):
                spark.sql(f"DROP TABLE IF EXISTS `{row.tableName}`")
    files = Files(spark)
    for path in gone:
        files.remove(path)
        SCRATCH.remove(path)
    return len(gone)


def _location(spark: SparkSession, table: str) -> str:
    told = spark.sql(f"DESCRIBE EXTENDED `{table}`").where("col_name = 'Location'").collect()
    return told[0].data_type if told else ""
