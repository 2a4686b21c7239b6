"""Loading files into tables: normalise, replace, count, report."""

from __future__ import annotations

import hashlib
import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyarrow import fs
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.joins import DuplicateKeyError, assert_unique_key, mark_unique
from panelwise.operators.key_ranges import assert_unique_stored
from panelwise.sources.files import resolve
from panelwise.sources.guard import landed_files
from panelwise.sources.registry import SURVEY, Entry
from panelwise.sources.store import DatabaseStore, FileStore

STATUS = "file string, table string, status string, reason string, rows bigint"
LOADED, FAILED = "loaded", "failed"
DOWNLOAD_FAILED, PARSE_FAILED, LOAD_FAILED = "download failed", "parse failed", "load failed"


def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def integer_key(key: str) -> Column:
    """The key as a whole number; the job fails on a key that is not one."""
    k = F.col(key)
    wrong = F.raise_error(F.concat(F.lit(f"{key} is not a whole number: "), k.cast("string")))
    return F.when(k.isNull() | (k == F.floor(k)), k.cast("bigint")).otherwise(wrong)


def normalised(df: DataFrame, key: str | None = None) -> DataFrame:
    """Lower-case column names and, if a key is named, a bigint key."""
    df = lowercase_columns(df)
    return df if key is None else df.withColumn(key, integer_key(key))


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """`df`, and the row count that its next write will leave behind.

    The count is taken in the tasks that write, so it neither reads the table
    again nor counts twice when an earlier stage has to be repeated.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def count_rows(df: DataFrame, check: Callable[[DataFrame], object] | None = None) -> int:
    """Rows of `df`, all of them decoded and, if asked, checked; nothing is written."""
    df, seen = counted(df)
    df.write.format("noop").mode("overwrite").save()
    if check is not None:
        check(df)
    return seen.get["rows"]


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], object] | None = None) -> int:
    """Write `df` in place of whatever is at `path`, a plain folder; returns the rows written.

    The rows are written beside the old table and, if asked, checked there.
    Then the old folder steps aside, the new one takes its place, and only then
    the old one is deleted; a step that fails is undone, and one left undone by
    a driver that was killed is undone by the next replacement. Where folders
    cannot be moved the old table stays and the call fails: use a store there
    (`store.FileStore`), which moves nothing.
    """
    spark, plain = df.sparkSession, path.rstrip("/")
    mark = uuid.uuid4().hex
    system, place = resolve(path)
    staged, aside = (resolve(f"{plain}.{kind}-{mark}")[1] for kind in ("loading", "replaced"))
    _restore(system, place)
    df, seen = counted(df)
    try:
        df.write.parquet(f"{plain}.loading-{mark}")
        if check is not None:
            check(spark.read.parquet(f"{plain}.loading-{mark}"))
        had = _is_folder(system, place)
        if had:
            system.move(place, aside)
        try:
            system.move(staged, place)
        except BaseException:
            if had:
                system.move(aside, place)  # if this fails, too, both tables are kept where they are
            raise
    except BaseException:
        if _is_folder(system, staged) and not _is_folder(system, aside):
            system.delete_dir(staged)
        raise
    if had:
        system.delete_dir(aside)
    spark.catalog.refreshByPath(path)
    return seen.get["rows"]


def _is_folder(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.Directory


def _restore(system: fs.FileSystem, place: str) -> None:
    """Put back a table that a killed replacement left aside, and remove what it left beside a whole one."""
    parent, _, name = place.rstrip("/").rpartition("/")
    if not _is_folder(system, parent):
        return
    beside = [i.path for i in system.get_file_info(fs.FileSelector(parent))]
    aside = sorted(p for p in beside if p.rpartition("/")[2].startswith(f"{name}.replaced-"))
    for path in aside:
        if _is_folder(system, place):
            system.delete_dir(path)
        else:
            system.move(path, place)


def replace_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, check: Callable[[DataFrame], object] | None = None
) -> int:
    """Write `df` over a catalog table bucketed by its unique key; returns the rows written.

    Tables with the same number of buckets join on the key without a shuffle.
    Rows are brought together per bucket first, so each bucket is one file. The
    new version has a folder of its own, and the table's name is pointed there
    once it is complete and checked; a failure leaves the old table as it was.
    """
    database, _, name = table.rpartition(".")
    store = DatabaseStore(df.sparkSession, database or None, key, buckets)
    return store.replace({name: df.repartition(buckets, key)}, key, check)[name]


def open_tables(spark: SparkSession, target: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables loaded as files, by name, all as one load left them.

    One pointer names the versions of all tables, and a load keeps the versions
    of the load before, so what is opened here can be read to its end while the
    tables are replaced once.
    """
    return FileStore(spark, target).open_all(names)


def open_bucketed(spark: SparkSession, database: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables loaded into buckets, by name, all as one load left them."""
    return DatabaseStore(spark, database).open_all(names)


def register_tables(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables known to `spark.sql` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def load_registry(
    spark: SparkSession,
    landing: str,
    target: str | None,
    entries: Sequence[Entry] = SURVEY,
    source: str = "xport",
    key: str | None = "seqn",
    check_key: bool = True,
    buckets: int | None = None,
    at_once: int = 4,
    fresh: bool = False,
) -> DataFrame:
    """Load every entry's file into its table; returns one status row per entry.

    `target` is a directory of Parquet tables or, with `buckets`, a database
    whose tables get that many buckets by the key. Choose buckets so that the
    largest table has a few hundred megabytes in each. Without a target the
    files are decoded, counted and checked, and nothing is written.

    An entry may be a file or a folder of files. A file that is absent, is an
    error page, or cannot be parsed is reported with the reason and the others
    go on; so do the good files of a folder. A failing sink is raised once all
    entries are done, and so is a key that is not unique unless `check_key` is
    off; the error's `statuses` holds the status rows. The driver only submits
    jobs, a few tables at a time.

    All tables that loaded become current in one step at the end; whoever opens
    tables sees the whole old set or the whole new one. If the driver is killed
    before, the next call goes on: entries that were complete, from files that
    have not changed since and with the same options, are not decoded again,
    unless `fresh` is set. What an abandoned load left behind is removed.
    """
    if buckets is not None and key is None:
        raise ValueError("bucketed tables need a key")
    uris = {e: f"{landing.rstrip('/')}/{e.file}" for e in entries}
    landed = list_landed(spark, [u for u in uris.values() if _kind(u) != fs.FileType.NotFound])
    checked = key is not None and check_key
    store = None
    if target is not None:
        store = FileStore(spark, target) if buckets is None else DatabaseStore(spark, target, key, buckets)
    journal = store.begin([e.table for e in entries], fresh) if store else None
    earlier: dict[str, dict] = {}
    if journal is not None:
        earlier, journal.done = journal.done, {}
    noting = Lock()

    def keep(df: DataFrame, table: str, origin: str) -> int:
        if store is None:
            return count_rows(df, (lambda d: assert_unique_key(d, key)) if checked else None)
        check = None
        if checked:
            check = (lambda d: assert_unique_stored(d, key)) if buckets is None else (lambda d: assert_unique_key(d, key))
        dealt = df if buckets is None else df.repartition(buckets, key)
        record = {**store.write(dealt, table, journal.load, key, check).record(), "origin": origin}
        with noting:
            journal.completed(table, record)
        return record["rows"]

    def load(entry: Entry) -> tuple[tuple, Exception | None]:
        def status(outcome: str, reason: str | None, rows: int | None = None) -> tuple:
            return (entry.file, entry.table, outcome, reason, rows)

        mine = landed.get(uris[entry])
        if mine is None:
            return status(FAILED, DOWNLOAD_FAILED), None
        df = None
        try:
            good, bad = mine.usable(None if source != "xport" else "xpt")
            if not good:
                return status(FAILED, DOWNLOAD_FAILED), None
            reason = f"{DOWNLOAD_FAILED}: {', '.join(bad)}" if bad else None
            origin = mine.origin(source, key, checked, buckets)
            before = earlier.get(entry.table)
            if before is not None and before["origin"] == origin and store.holds(before["version"]):
                with noting:
                    journal.completed(entry.table, before)
                return status(LOADED, reason, before["rows"]), None
            reader = spark.read.format(source)
            if source == "xport":
                reader = reader.option("listing", json.dumps([[f.path, f.size] for f in good]))
            paths = [f.path for f in good] if bad else [uris[entry]]
            read = normalised(reader.load(paths if len(paths) > 1 else paths[0]), key)
            df = mark_unique(read, key) if checked else read
            rows = keep(df, entry.table, origin)
        except Exception as e:  # noqa: BLE001 - one entry must not hide the status of the others
            unread = _read_error(df, e)
            if unread is not None:
                return status(FAILED, f"{PARSE_FAILED}: {_summary(unread)}"), None
            return status(FAILED, f"{LOAD_FAILED}: {_summary(e)}"), e
        return status(LOADED, reason, rows), None

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(load), entries))
    if store is not None:
        store.finish(journal, [e.table for e in entries])
    statuses = [row for row, _ in results]
    for _, error in results:
        if error is not None:
            error.statuses = statuses
            raise error
    return spark.createDataFrame(statuses, STATUS)


def _kind(uri: str) -> fs.FileType:
    system, path = resolve(uri)
    return system.get_file_info(path).type


@dataclass(frozen=True)
class LandedFile:
    path: str
    size: int
    modified: str
    is_error_page: bool


@dataclass(frozen=True)
class Landed:
    """What landed for one entry: a file, or the files in and below a folder."""

    place: str
    files: tuple[LandedFile, ...]

    def usable(self, extension: str | None) -> tuple[list[LandedFile], list[str]]:
        """The files to read, and the paths, in the entry, of the error pages among them."""
        bad = [_below(f.path, self.place) for f in self.files if f.is_error_page]
        alone = [f for f in self.files if resolve(f.path)[1] == self.place]
        good = [f for f in self.files if f in alone or extension is None or f.path.lower().endswith(f".{extension}")]
        return [f for f in good if not f.is_error_page], bad

    def origin(self, *options: object) -> str:
        """A digest that changes when any file or option does."""
        told = [[f.path, f.size, f.modified, f.is_error_page] for f in self.files]
        return hashlib.sha256(json.dumps([told, [str(o) for o in options]]).encode()).hexdigest()


def _below(path: str, place: str) -> str:
    return resolve(path)[1].removeprefix(place).lstrip("/")


def list_landed(spark: SparkSession, uris: Sequence[str]) -> dict[str, Landed]:
    """Per URI what landed there, from one listing of them all, which Spark makes in tasks where it is long.

    The listing is what the driver needs to plan reads: path, size and time of
    each file, and whether its head is that of an error page.
    """
    if not uris:
        return {}
    files = [
        LandedFile(r.path, r.length, str(r.modificationTime), r.is_error_page)
        for r in landed_files(spark, *uris).collect()
    ]
    files.sort(key=lambda f: f.path)
    paths = [resolve(f.path)[1] for f in files]
    found = {}
    for uri in uris:
        place = resolve(uri)[1].rstrip("/")
        first, last = bisect_left(paths, place), bisect_left(paths, place + chr(0x10FFFF))
        own = [f for f, p in zip(files[first:last], paths[first:last], strict=True) if p == place or p.startswith(f"{place}/")]
        if not own and _kind(uri) == fs.FileType.File:  # files without a byte are not listed
            own = [LandedFile(uri, 0, "", False)]
        found[uri] = Landed(place, tuple(own))
    return found


def _read_error(df: DataFrame | None, error: Exception) -> Exception | None:
    """The error if reading is what failed: the file is read again without a sink to tell."""
    if df is None:
        return error
    if isinstance(error, DuplicateKeyError):
        return None
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception as again:  # noqa: BLE001
        return again
    return None


def _summary(error: Exception) -> str:
    """The line of a message that says most."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()] or [type(error).__name__]
    return next((line for line in lines if "TransportFormatError" in line), lines[0])
