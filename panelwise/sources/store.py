"""Where loaded tables live: a folder of tables, or a database of bucketed ones.

Both keep every version of a table apart and share one pointer for all tables
(`versions`), so opening several tables gives one consistent set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.joins import hottest_rows, hottest_sketch, mark_unique, note_hottest
from panelwise.sources.versions import KEPT_POINTERS, Journal, Snapshot, Versions

Check = Callable[[DataFrame], object]


@dataclass(frozen=True)
class Written:
    """A complete version: its name, its rows, and what is known of its key."""

    version: str
    rows: int
    notes: dict

    def record(self) -> dict:
        return {"version": self.version, "rows": self.rows, "notes": self.notes}


class Store:
    """What the two kinds of store share; they differ in how a version is written, read and removed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)

    def put(self, df: DataFrame, version: str) -> None:
        raise NotImplementedError

    def get(self, version: str) -> DataFrame:
        raise NotImplementedError

    def holds(self, version: str) -> bool:
        raise NotImplementedError

    def drop(self, version: str) -> None:
        raise NotImplementedError

    def name(self, table: str, load: str) -> str:
        raise NotImplementedError

    def written(self, table: str) -> list[str]:
        """Every version of a table that lies in the store, complete or not."""
        raise NotImplementedError

    def plain(self, table: str) -> DataFrame:
        """A table that was put there without a pointer."""
        raise NotImplementedError

    def publish(self, snapshot: Snapshot, tables: Iterable[str]) -> None:
        """Make the versions known elsewhere, where that is needed."""

    def write(
        self, df: DataFrame, table: str, load: str, key: str | None = None, check: Check | None = None
    ) -> Written:
        """Write a version of a table and, if asked, check that its key is unique. Nobody sees it before a commit.

        Rows, and of an unchecked table the commonest key, are counted by the tasks that write.
        """
        version, seen = self.name(table, load), Observation()
        sketched = key is not None and check is None
        measures = [F.count(F.lit(1)).alias("rows"), *([hottest_sketch(key).alias("top")] if sketched else [])]
        self.put(df.observe(seen, *measures), version)
        rows = seen.get["rows"]
        if check is not None:
            check(self.get(version))
        notes = {} if key is None else {"key": key, "unique": check is not None}
        if sketched:
            notes["hottest"] = hottest_rows(seen.get["top"], rows)
        return Written(version, rows, notes)

    def open(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table of a snapshot, by default of the current one."""
        entry = (snapshot or self.versions.current()).tables.get(table)
        if entry is None:
            return self.plain(table)
        return noted(self.get(entry["version"]), entry.get("notes") or {})

    def open_all(self, tables: Sequence[str]) -> dict[str, DataFrame]:
        """Several tables as one commit left them: the pointer is read once."""
        snapshot = self.versions.current()
        return {t: self.open(t, snapshot) for t in tables}

    def replace(
        self, tables: Mapping[str, DataFrame], key: str | None = None, check: Check | None = None
    ) -> dict[str, int]:
        """Replace several tables in one step; returns their rows. A failure leaves all as they were."""
        journal = self.begin(tables, fresh=True)
        written = {t: self.write(df, t, journal.load, key, check) for t, df in tables.items()}
        for table, one in written.items():
            journal.completed(table, one.record())
        self.finish(journal, tables)
        return {t: w.rows for t, w in written.items()}

    def begin(self, tables: Iterable[str], fresh: bool = False) -> Journal:
        """Open a load's journal, and publish what a driver killed after its commit could not."""
        self.publish(self.versions.current(), tables)
        return self.versions.begin(fresh)

    def finish(self, journal: Journal, tables: Iterable[str], keep: int = KEPT_POINTERS) -> None:
        """Commit a load, publish it, and remove what no snapshot kept refers to.

        Only after the commit is anything removed. What a failure here leaves
        behind, the next load of these tables removes.
        """
        snapshot = journal.commit()
        self.publish(snapshot, tables)
        gone = set(self.versions.clean(keep))
        held = {t["version"] for s in self.versions.retained(keep) for t in s.tables.values()}
        gone |= {v for t in tables for v in self.written(t)} - held
        for version in sorted(gone):
            self.drop(version)


def noted(df: DataFrame, notes: Mapping) -> DataFrame:
    """A stored table with what its load found out about the key."""
    key = notes.get("key")
    if key is None or key not in df.columns:
        return df
    if notes.get("unique"):
        return mark_unique(df, key)
    return note_hottest(df, key, notes["hottest"]) if "hottest" in notes else df


class FileStore(Store):
    """Tables as Parquet folders `<root>/<table>/<version>`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)
        self.root = root.rstrip("/")

    def name(self, table: str, load: str) -> str:
        return f"{table}/{load}"

    def put(self, df: DataFrame, version: str) -> None:
        df.write.parquet(f"{self.root}/{version}")

    def get(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version}")

    def holds(self, version: str) -> bool:
        return self.versions.files.exists(f"{self.root}/{version}/_SUCCESS")

    def drop(self, version: str) -> None:
        self.versions.files.remove(f"{self.root}/{version}")

    def written(self, table: str) -> list[str]:
        names = self.versions.files.folders(f"{self.root}/{table}")
        return [f"{table}/{n}" for n in names if n.startswith("v-")]

    def plain(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")


class DatabaseStore(Store):
    """Tables of a database, bucketed by a key; a version is a catalog table on a folder of its own.

    The plain table name is an entry on the folder of the current version, for
    SQL: a replacement with the same columns and buckets sets its location,
    which the catalog does in one step. With other columns the entry is
    dropped and made again; the library itself reads versions by the pointer
    and is not touched by that. Files belong to versions, so no entry that is
    dropped takes any along.
    """

    def __init__(self, spark: SparkSession, database: str | None, key: str | None = None, buckets: int | None = None) -> None:
        self.database = database or spark.catalog.currentDatabase()
        told = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE DATABASE `{self.database}`").collect()}
        # Hidden from whoever reads the folder of a table that Spark itself keeps there.
        super().__init__(spark, f"{told['Location'].rstrip('/')}/_tables")
        self.key, self.buckets = key, buckets

    def _named(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def name(self, table: str, load: str) -> str:
        return f"{table}__{load.replace('-', '_')}"

    def _folder(self, version: str) -> str:
        table, load = version.rsplit("__", 1)
        return f"{self.versions.root}/{table}/{load}"

    def put(self, df: DataFrame, version: str) -> None:
        writer = df.write.format("parquet").option("path", self._folder(version))
        writer.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self._named(version))

    def get(self, version: str) -> DataFrame:
        return self.spark.table(self._named(version))

    def holds(self, version: str) -> bool:
        return self.spark.catalog.tableExists(self._named(version))

    def drop(self, version: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._named(version)}")
        self.versions.files.remove(self._folder(version))

    def written(self, table: str) -> list[str]:
        known = self.spark.sql(f"SHOW TABLES IN `{self.database}` LIKE '{table.lower()}__v_*'").collect()
        on_disk = self.versions.files.folders(f"{self.versions.root}/{table}")
        return sorted({r.tableName for r in known} | {f"{table}__{load}" for load in on_disk})

    def plain(self, table: str) -> DataFrame:
        return self.spark.table(self._named(table))

    def _layout(self, name: str) -> tuple[tuple, str]:
        """Columns and buckets of a catalog entry, and where it lies."""
        told = self.spark.sql(f"DESCRIBE EXTENDED {self._named(name)}").collect()
        shown = {r.col_name: r.data_type for r in told}
        buckets = [shown.get(c) for c in ("Type", "Num Buckets", "Bucket Columns", "Sort Columns")]
        return (self.spark.table(self._named(name)).dtypes, *buckets), shown["Location"]

    def publish(self, snapshot: Snapshot, tables: Iterable[str]) -> None:
        for table in tables:
            entry = snapshot.tables.get(table)
            if entry is None:
                continue
            version, folder = entry["version"], self._folder(entry["version"])
            if self.spark.catalog.tableExists(self._named(table)):
                (layout, place), (wanted, goal) = self._layout(table), self._layout(version)
                if layout == wanted:
                    if place != goal:
                        self.spark.sql(f"ALTER TABLE {self._named(table)} SET LOCATION '{folder}'")
                    continue
                self.spark.sql(f"DROP TABLE {self._named(table)}")
            self.spark.sql(f"CREATE TABLE {self._named(table)} LIKE {self._named(version)} LOCATION '{folder}'")
