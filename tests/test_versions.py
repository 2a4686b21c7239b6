"""Versions of tables: one pointer for a whole set, safe at every step, resumable loads."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from panelwise.operators.joins import DuplicateKeyError, assert_unique_key, known_unique
from panelwise.sources import load as loading
from panelwise.sources.load import load_registry, open_bucketed, open_tables, replace_bucketed, replace_table
from panelwise.sources.registry import Entry
from panelwise.sources.store import DatabaseStore, FileStore
from panelwise.sources.versions import Files, LoadTakenOver, Versions, sealed, unsealed
from tests.test_ingest import land


class Killed(BaseException):
    """Stands for a driver that dies: nothing may catch it and clean up."""


def values(df):
    return sorted(r[0] for r in df.collect())


def steps_of(monkeypatch, names, act):
    """Run `act`, which fails before or after the n-th of the named calls; yields n and whether it failed."""
    for when in ("before", "after"):
        n = 0
        while True:
            calls = 0

            def wrap(original, n=n):
                def call(self, *args, **kwargs):
                    nonlocal calls
                    mine, calls = calls, calls + 1
                    if mine == n and when == "before":
                        raise Killed
                    out = original(self, *args, **kwargs)
                    if mine == n:
                        raise Killed
                    return out

                return call

            with monkeypatch.context() as patch:
                for kind, name in names:
                    patch.setattr(kind, name, wrap(getattr(kind, name)))
                try:
                    act()
                    failed = False
                except Killed:
                    failed = True
            yield n, failed
            if not failed:
                break
            n += 1
        assert n > 3


def test_sealed_files_tell_when_they_are_cut():
    raw = sealed({"a": [1, "é"]})
    assert unsealed(raw) == {"a": [1, "é"]}
    assert all(unsealed(raw[:n]) is None for n in range(len(raw)))
    assert unsealed(raw.replace(b"1", b"2", 1)) is None
    assert unsealed(b"[]") is None and unsealed(b'{"body": 3, "crc32": 1}') is None


def test_a_pointer_that_is_not_whole_is_passed_over(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    store.replace({"a": spark.range(3)})
    store.versions.files.write_new(f"{tmp_path}/_versions/000000000002.json", sealed({"tables": {}})[:-4])
    assert store.versions.current().number == 1
    store.replace({"a": spark.range(5)})
    assert store.versions.current().number == 3
    assert store.open("a").count() == 5


def test_a_failure_at_any_step_leaves_a_whole_set(spark, tmp_path, monkeypatch):
    store = FileStore(spark, str(tmp_path))
    now = 1
    store.replace({t: spark.range(now) for t in "ab"})
    names = [(Files, "write_new"), (Files, "remove"), (FileStore, "put"), (FileStore, "drop"), (Versions, "commit")]

    def replace():
        store.replace({t: spark.range(now + 1) for t in "ab"})

    for _, failed in steps_of(monkeypatch, names, replace):
        counts = {df.count() for df in open_tables(spark, str(tmp_path), "ab").values()}
        assert len(counts) == 1 and counts <= {now, now + 1}
        assert failed or counts == {now + 1}
        now = counts.pop()
    store.replace({t: spark.range(2) for t in "ab"})
    assert {t: len(os.listdir(tmp_path / t)) for t in "ab"} == {"a": 2, "b": 2}  # this version and the one before
    assert os.listdir(tmp_path / "_loads") == []


def test_no_folder_is_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(loading, "resolve", lambda _: pytest.fail("moves and deletes folders by itself"))
    renamed = []
    monkeypatch.setattr(os, "rename", lambda *a: renamed.append(a))
    store = FileStore(spark, str(tmp_path))
    assert store.replace({"a": spark.range(3)}) == {"a": 3}
    held = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert store.replace({"a": spark.range(4)}) == {"a": 4}
    assert set(held) < {p.name for p in (tmp_path / "a").iterdir()} and not renamed
    assert store.open("a").count() == 4


def test_a_failing_check_keeps_the_old_tables(spark, frame, tmp_path):
    store = FileStore(spark, str(tmp_path))
    good, repeated = frame("k long", [(1,), (2,)]), frame("k long", [(7,), (7,)])
    broken = frame("k long", [(1,)]).selectExpr("CAST(raise_error('bad') AS bigint) AS k")

    def check(df):
        return assert_unique_key(df, "k")

    store.replace({"a": good}, "k", check)
    for bad, error in ((repeated, DuplicateKeyError), (broken, Exception)):
        with pytest.raises(error):
            store.replace({"a": good, "b": bad}, "k", check)
        assert list(store.versions.current().tables) == ["a"]
        assert values(store.open("a")) == [1, 2]


def test_an_open_set_outlives_one_replacement(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    store.replace({"a": spark.range(3), "b": spark.range(3)})
    held = open_tables(spark, str(tmp_path), ["a", "b"])
    snapshot = store.versions.current()
    store.replace({"a": spark.range(5), "b": spark.range(5)})
    assert {held["a"].count(), held["b"].count()} == {3}
    assert store.open("a", snapshot).count() == 3 and store.open("a").count() == 5


def test_tables_of_one_load_change_together(spark, tmp_path):
    """A reader that opens the set over and over never sees tables of two loads."""
    store = FileStore(spark, str(tmp_path))
    store.replace({t: spark.range(1) for t in "abc"})
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            snapshot = store.versions.current()
            seen.append({t["version"].split("/")[1] for t in snapshot.tables.values()})

    reader = threading.Thread(target=watch)
    reader.start()
    for n in (2, 3, 4):
        store.replace({t: spark.range(n) for t in "abc"})
    stop.set()
    reader.join()
    assert seen and all(len(loads) == 1 for loads in seen)


def test_a_taken_number_makes_the_second_commit_start_again(spark, tmp_path, monkeypatch):
    versions = Versions(spark, str(tmp_path))
    original, raced = Files.write_new, []

    def race(self, path, content):
        if not raced and "_versions" in path:
            raced.append(path)
            Versions(spark, str(tmp_path)).commit({"other": {"version": "w"}})
        return original(self, path, content)

    monkeypatch.setattr(Files, "write_new", race)
    assert set(versions.commit({"mine": {"version": "v"}}).tables) == {"other", "mine"}


def test_tables_put_there_without_a_pointer_are_opened(spark, tmp_path):
    replace_table(spark.range(4), str(tmp_path / "old"))
    FileStore(spark, str(tmp_path)).replace({"new": spark.range(2)})
    tables = open_tables(spark, str(tmp_path), ["old", "new"])
    assert {t: df.count() for t, df in tables.items()} == {"old": 4, "new": 2}


# Plain folders


def test_a_plain_folder_comes_back_when_the_second_move_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace_table(spark.range(3), path)
    real = loading.resolve

    class Stubborn:
        """The local file system, where folders cannot be moved to the table's place."""

        def __init__(self, system, refused):
            self.system, self.refused = system, refused

        def __getattr__(self, name):
            return getattr(self.system, name)

        def move(self, source, goal):
            if self.refused(source, goal):
                raise OSError("cannot be moved")
            self.system.move(source, goal)

    for refused in (lambda s, g: True, lambda s, g: ".loading-" in s):
        with monkeypatch.context() as patch:
            patch.setattr(loading, "resolve", lambda uri, r=refused: (Stubborn(real(uri)[0], r), real(uri)[1]))
            with pytest.raises(OSError, match="cannot be moved"):
                replace_table(spark.range(5), path)
        assert spark.read.parquet(path).count() == 3
        assert os.listdir(tmp_path) == ["t"]


def test_a_replacement_killed_between_moves_is_undone_by_the_next(spark, tmp_path):
    path = tmp_path / "t"
    replace_table(spark.range(3), str(path))
    path.rename(tmp_path / "t.replaced-dead")
    with pytest.raises(Exception, match="bad"):
        replace_table(spark.range(1).selectExpr("raise_error('bad') AS x"), str(path))
    assert spark.read.parquet(str(path)).count() == 3
    assert replace_table(spark.range(6), str(path)) == 6
    assert os.listdir(tmp_path) == ["t"]


# Databases


@pytest.fixture
def database(spark):
    name = f"db_{os.urandom(4).hex()}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_a_failure_at_any_step_leaves_bucketed_tables(spark, database, monkeypatch):
    now = 4
    replace_bucketed(spark.range(now).toDF("k"), f"{database}.t", "k", 2)
    names = [
        (Files, "write_new"), (Files, "remove"), (DatabaseStore, "put"), (DatabaseStore, "publish"),
        (DatabaseStore, "drop"), (Versions, "commit"),
    ]

    def replace():
        replace_bucketed(spark.range(now + 1).toDF("k"), f"{database}.t", "k", 2)

    for _, failed in steps_of(monkeypatch, names, replace):
        count = open_bucketed(spark, database, ["t"])["t"].count()
        assert count in (now, now + 1) and (failed or count == now + 1)
        assert spark.table(f"{database}.t").count() in (now, now + 1)  # the entry for SQL may lag behind
        now = count
    replace()
    assert spark.table(f"{database}.t").count() == now + 1
    versions = [r for r in spark.sql(f"SHOW TABLES IN {database}").collect() if not r.isTemporary]
    assert len(versions) == 3  # the entry, this version and the one before


def test_columns_and_buckets_may_change(spark, database):
    table = f"{database}.t"
    replace_bucketed(spark.range(10).toDF("k"), table, "k", 2)
    replace_bucketed(spark.range(8).selectExpr("id AS k", "'x' AS word"), table, "k", 2)
    assert spark.table(table).columns == ["k", "word"] and spark.table(table).count() == 8
    replace_bucketed(spark.range(90).selectExpr("id AS k", "'x' AS word"), table, "k", 4)
    assert len(spark.table(table).inputFiles()) == 4 and spark.table(table).count() == 90


def test_an_entry_that_spark_kept_itself_is_replaced(spark, database):
    spark.range(7).toDF("k").write.saveAsTable(f"{database}.t")
    assert open_bucketed(spark, database, ["t"])["t"].count() == 7
    replace_bucketed(spark.range(3).toDF("k"), f"{database}.t", "k", 2)
    assert open_bucketed(spark, database, ["t"])["t"].count() == spark.table(f"{database}.t").count() == 3


def test_notes_of_the_key_survive_in_both_stores(spark, database, tmp_path):
    files, tables = FileStore(spark, str(tmp_path)), DatabaseStore(spark, database, "k", 2)
    for store in (files, tables):
        store.replace({"a": spark.range(5).toDF("k")}, "k", lambda df: assert_unique_key(df, "k"))
        assert known_unique(store.open("a"), "k")
        store.replace({"a": spark.range(5).select(F.lit(1).cast("long").alias("k"))}, "k")
        assert not known_unique(store.open("a"), "k")


# Loads


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for i, name in enumerate("ABC"):
        land(folder / f"{name}.xpt", {"SEQN": [float(n) for n in range(i + 2)]})
    return folder


ENTRIES = [Entry(f"{c}.xpt", c.lower(), "") for c in "ABC"]


def outcome(df):
    return {r.table: (r.status, r.rows) for r in df.collect()}


LOADED = {"a": ("loaded", 2), "b": ("loaded", 3), "c": ("loaded", 4)}


@pytest.mark.parametrize("buckets", [None, 2])
def test_a_killed_load_goes_on_where_it_stopped(spark, landing, tmp_path, database, monkeypatch, buckets):
    target = database if buckets else str(tmp_path / "out")
    kind = DatabaseStore if buckets else FileStore
    put, written = kind.put, []

    def dies_at_c(self, df, version):
        if version.startswith("c"):
            put(self, df, version)  # leaves a folder nobody will ever commit
            raise Killed
        written.append(version[0])
        put(self, df, version)

    monkeypatch.setattr(kind, "put", dies_at_c)
    with pytest.raises(Killed):
        load_registry(spark, str(landing), target, ENTRIES, buckets=buckets, at_once=1)
    store = kind(spark, target)
    assert store.versions.current().tables == {}

    def counts(self, df, version):
        written.append(version[0])
        put(self, df, version)

    monkeypatch.setattr(kind, "put", counts)
    assert outcome(load_registry(spark, str(landing), target, ENTRIES, buckets=buckets, at_once=1)) == LOADED
    assert written == ["a", "b", "c"]  # a and b were not decoded again
    assert {t: len(store.written(t)) for t in "abc"} == {"a": 1, "b": 1, "c": 1}
    assert store.versions.files.folders(f"{store.versions.root}/_loads") == []
    assert {t: df.count() for t, df in store.open_all("abc").items()} == {"a": 2, "b": 3, "c": 4}


def kill_at(monkeypatch, table):
    put = FileStore.put

    def dies(self, df, version):
        if version.startswith(table):
            raise Killed
        put(self, df, version)

    monkeypatch.setattr(FileStore, "put", dies)
    return lambda: monkeypatch.setattr(FileStore, "put", put)


def test_changed_files_and_options_are_loaded_again(spark, landing, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    for change in ("file", "option", "fresh"):
        revive = kill_at(monkeypatch, "c")
        with pytest.raises(Killed):
            load_registry(spark, str(landing), target, ENTRIES, at_once=1)
        revive()
        options = {}
        if change == "file":
            land(landing / "A.xpt", {"SEQN": [float(n) for n in range(9)]})
        elif change == "option":
            options = {"check_key": False}
        else:
            options = {"fresh": True}
        before = {t["version"] for s in FileStore(spark, target).versions.retained() for t in s.tables.values()}
        got = outcome(load_registry(spark, str(landing), target, ENTRIES, at_once=1, **options))
        assert got == {**LOADED, "a": ("loaded", 9)}
        assert FileStore(spark, target).open("a").count() == 9
        assert FileStore(spark, target).versions.current().tables["a"]["version"] not in before
        assert all(len(FileStore(spark, target).written(t)) <= 2 for t in "abc")


def test_a_load_that_was_taken_over_does_not_commit(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    old = store.versions.begin()
    old.completed("a", store.write(spark.range(1), "a", old.load).record())
    new = store.versions.begin()
    assert set(new.done) == {"a"}
    with pytest.raises(LoadTakenOver):
        old.commit()
    assert store.versions.current().tables == {}
    new.commit()
    assert store.open("a").count() == 1


def test_failed_entries_keep_their_old_tables(spark, landing, tmp_path):
    target = str(tmp_path / "out")
    load_registry(spark, str(landing), target, ENTRIES)
    land(landing / "A.xpt", {"SEQN": [1.0, 1.0]})
    land(landing / "B.xpt", {"SEQN": [5.0]})
    (landing / "C.xpt").write_bytes(b"no longer a table")
    with pytest.raises(DuplicateKeyError):
        load_registry(spark, str(landing), target, ENTRIES)
    tables = open_tables(spark, target, "abc")
    assert {t: df.count() for t, df in tables.items()} == {"a": 2, "b": 1, "c": 4}


def test_files_are_listed_once(spark, tmp_path, monkeypatch):
    folder = tmp_path / "landing/many"
    folder.mkdir(parents=True)
    for i in range(30):
        land(folder / f"{i}.xpt", {"SEQN": [float(i)]})
    listed = []
    real = loading.landed_files
    monkeypatch.setattr(loading, "landed_files", lambda *a: listed.append(a) or real(*a))
    from panelwise.sources import transport

    monkeypatch.setattr(transport, "list_files", lambda *a: pytest.fail("listed again"))
    got = load_registry(spark, str(tmp_path / "landing"), str(tmp_path / "out"), [Entry("many", "many", "")])
    assert outcome(got) == {"many": ("loaded", 30)} and len(listed) == 1
