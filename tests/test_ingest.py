"""From landed files to tables: guard, normalisation, replacement, status."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwise.fixtures.respondents import VIEWS
from panelwise.fixtures.transport_files import OutField, encode_batch, header
from panelwise.operators.joins import DuplicateKeyError
from panelwise.plans.studies import STUDIES
from panelwise.session import scratch_dir
from panelwise.sources.guard import is_error_page, landed_files, text_head
from panelwise.sources.load import (
    load_registry,
    lowercase_columns,
    normalised,
    open_bucketed,
    open_tables,
    register_tables,
    replace_bucketed,
    replace_table,
)
from panelwise.sources.registry import SURVEY, Entry, registry
from panelwise.sources.transport import NUMERIC, TEXT
from tests import survey as plain

ERROR_PAGE = b"<!DOCTYPE html>\n<html><title>Page Not Found</title></html>"


def land(path, columns: dict[str, list]) -> None:
    fields = [OutField(name, NUMERIC, 8) for name in columns]
    data = pa.record_batch({n: pa.array(v, pa.float64()) for n, v in columns.items()})
    body = encode_batch(data, fields)
    path.write_bytes(header(fields) + body + b" " * (-len(body) % 80))


def status_of(df):
    return {
        row.file: (row.table, row.status, row.reason and row.reason.split(":")[0], row.rows)
        for row in df.collect()
    }


def test_registry_lists_27_components(spark):
    assert len(SURVEY) == 27 == len({e.table for e in SURVEY}) == len({e.file for e in SURVEY})
    assert set(VIEWS) <= {e.table for e in SURVEY}
    assert registry(spark).columns == ["file", "table", "description"]
    assert registry(spark).count() == 27


@pytest.mark.parametrize(("content", "bad"), [
    (ERROR_PAGE, True),
    (b"<!DOCTYPE html> fine", False),
    (b"Page Not Found", False),
    (b"<!DOCTYPE html>" + b" " * 1000 + b"Page Not Found", False),
    (b"<!DOCTYPE html>" + b" " * 995 + b"Page Not Found", True),
    (b"<!DOC\xffTYPE html>\xfe Page Not Found", True),
    (b"<!doctype html> page not found", False),
    (b"no text at all", False),
])
def test_error_pages_are_told_by_their_head(content, bad, spark, tmp_path):
    (tmp_path / "x.xpt").write_bytes(content)
    row = landed_files(spark, str(tmp_path)).first()
    assert (row.is_error_page, row.length) == (bad, len(content))


def test_unreadable_head_is_no_error_page(frame):
    df = frame("head binary", [(None,), (bytearray(ERROR_PAGE),)])
    assert [r[0] for r in df.select(is_error_page(F.col("head"))).collect()] == [False, True]


def test_text_head_counts_bytes(frame):
    df = frame("t string", [("é" * 512 + "x",), ("<!DOCTYPE html>" + "é" * 500,)])
    assert [len(r[0]) for r in df.select(text_head(F.col("t"))).collect()] == [1024, 1015]


def test_bad_files_are_told_in_the_landing_folder(spark, tmp_path):
    land(tmp_path / "good.xpt", {"SEQN": [1.0]})
    (tmp_path / "bad.xpt").write_bytes(ERROR_PAGE)
    files = landed_files(spark, str(tmp_path))
    bad = files.filter("is_error_page")
    assert files.count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.xpt"]


def test_names_and_key_are_normalised(frame):
    df = frame("SEQN double, BMXbmi double", [(1.0, 2.5), (None, 3.0)])
    assert lowercase_columns(df).columns == ["seqn", "bmxbmi"]
    out = normalised(df, "seqn")
    assert out.dtypes == [("seqn", "bigint"), ("bmxbmi", "double")]
    assert [tuple(r) for r in out.collect()] == [(1, 2.5), (None, 3.0)]
    with pytest.raises(Exception, match="seqn is not a whole number: 1.5"):
        normalised(frame("SEQN double", [(1.5,)]), "seqn").collect()


def test_replacing_changes_rows_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    assert replace_table(spark.range(10).toDF("a"), path) == 10
    assert replace_table(spark.range(3).selectExpr("id AS b", "'x' AS c"), path) == 3
    assert spark.read.parquet(path).columns == ["b", "c"]
    assert replace_table(spark.range(0).toDF("a"), path) == 0
    assert spark.read.parquet(path).count() == 0


def test_load_reports_each_file_and_goes_on(spark, tmp_path):
    land(tmp_path / "A.xpt", {"SEQN": [1.0, 2.0, 3.0], "BMXBMI": [20.0, None, 31.5]})
    (tmp_path / "B.xpt").write_bytes(ERROR_PAGE)
    (tmp_path / "C.xpt").write_bytes(b"neither a page nor a table")
    land(tmp_path / "E.xpt", {"SEQN": []})
    latin = header([OutField("W", TEXT, 4)]) + b"ab\xff ".ljust(80)
    (tmp_path / "F.xpt").write_bytes(latin)
    entries = [Entry(f"{c}.xpt", f"t_{c.lower()}", "") for c in "ABCDE"]
    target = str(tmp_path / "out")
    got = status_of(load_registry(spark, str(tmp_path), target, entries))
    assert got == {
        "A.xpt": ("t_a", "loaded", None, 3),
        "B.xpt": ("t_b", "failed", "download failed", None),
        "C.xpt": ("t_c", "failed", "parse failed", None),
        "D.xpt": ("t_d", "failed", "download failed", None),
        "E.xpt": ("t_e", "loaded", None, 0),
    }
    keyless = [Entry("F.xpt", "t_f", "")]
    got = status_of(load_registry(spark, str(tmp_path), target, keyless, key=None))
    assert got["F.xpt"] == ("t_f", "failed", "parse failed", None)
    table = open_tables(spark, target, ["t_a"])["t_a"]
    assert table.dtypes == [("seqn", "bigint"), ("bmxbmi", "double")]
    assert sorted(map(tuple, table.collect())) == [(1, 20.0), (2, None), (3, 31.5)]


def test_loading_again_replaces(spark, tmp_path):
    entry = [Entry("A.xpt", "a", "")]
    for rows in (5, 2):
        land(tmp_path / "A.xpt", {"SEQN": [float(i) for i in range(rows)]})
        load_registry(spark, str(tmp_path), str(tmp_path / "out"), entry).collect()
    assert open_tables(spark, str(tmp_path / "out"), ["a"])["a"].count() == 2


def test_repeated_key_stops_the_load_unless_allowed(spark, tmp_path):
    land(tmp_path / "A.xpt", {"SEQN": [1.0, 1.0]})
    entry = [Entry("A.xpt", "a", "")]
    land(tmp_path / "B.xpt", {"SEQN": [1.5]})
    land(tmp_path / "C.xpt", {"SEQN": [1.0]})
    others = [Entry("B.xpt", "b", ""), Entry("C.xpt", "c", "")]
    for target in (str(tmp_path / "out"), None):
        with pytest.raises(DuplicateKeyError) as raised:
            load_registry(spark, str(tmp_path), target, [*entry, *others])
        got = [(s[2], s[3] and s[3].split(":")[0], s[4]) for s in raised.value.statuses]
        assert got == [("failed", "load failed", None), ("failed", "parse failed", None), ("loaded", None, 1)]
    loose = load_registry(spark, str(tmp_path), str(tmp_path / "out"), entry, check_key=False)
    assert loose.first().rows == 2


def test_failing_sink_is_not_hidden(spark, tmp_path):
    land(tmp_path / "A.xpt", {"SEQN": [1.0]})
    (tmp_path / "out").write_text("a file where the folder should be")
    with pytest.raises(Exception):  # noqa: B017
        load_registry(spark, str(tmp_path), str(tmp_path / "out"), [Entry("A.xpt", "a", "")])


def test_from_transport_files_to_studies(spark, tmp_path):
    survey = plain.random_survey(11, 60)
    landing = tmp_path / "landing"
    landing.mkdir()
    files = {e.table: e.file for e in SURVEY}
    for table, rows in survey.items():
        names = ["seqn", *plain.COLUMNS[table]]
        columns = {
            n: [None if r[i] is None else float(r[i]) for r in rows]
            for i, n in enumerate(names)
        }
        land(landing / files[table], columns)
    target = str(tmp_path / "tables")
    status = status_of(load_registry(spark, str(landing), target))
    assert sum(s[1] == "loaded" for s in status.values()) == 9
    assert sum(s[2] == "download failed" for s in status.values()) == 18
    tables = open_tables(spark, target, list(survey))
    people = plain.adults(survey)
    got = [tuple(r) for r in STUDIES["q3_access_by_coverage"](tables).collect()]
    assert got == plain.access(people)
    register_tables(tables)
    n = spark.sql("SELECT count(*) AS n FROM demographics WHERE ridageyr >= 18").first().n
    assert n == len(people)


def test_load_into_buckets(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS loaded")
    ids = [float(i) for i in range(300)]
    land(tmp_path / "A.xpt", {"SEQN": ids, "X": ids})
    land(tmp_path / "B.xpt", {"SEQN": [1.0, 1.0]})
    entries = [Entry("A.xpt", "a", "")]
    status = load_registry(spark, str(tmp_path), "loaded", entries, buckets=3)
    assert status.first().rows == 300
    table = open_bucketed(spark, "loaded", ["a"])["a"]
    assert table.dtypes == [("seqn", "bigint"), ("x", "double")]
    assert sorted(r.seqn for r in table.collect()) == list(range(300))
    assert len(table.inputFiles()) == 3
    with pytest.raises(DuplicateKeyError):
        load_registry(spark, str(tmp_path), "loaded", [Entry("B.xpt", "b", "")], buckets=3)


def test_bucketed_tables_hold_one_file_per_bucket(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS buckets")
    df = spark.range(1000).toDF("seqn")
    assert replace_bucketed(df, "buckets.t", "seqn", 4) == 1000
    assert replace_bucketed(df.filter("seqn < 500"), "buckets.t", "seqn", 4) == 500
    stored = spark.table("buckets.t")
    assert stored.count() == 500
    assert len(stored.inputFiles()) == 4


def test_scratch_dir_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert one.startswith(f"{shared}/x-") and one != two


def test_a_failed_load_leaves_the_old_table(spark, frame, tmp_path):
    from panelwise.operators.joins import DuplicateKeyError, assert_unique_key
    from panelwise.sources.load import replace_bucketed, replace_table

    good, repeated = frame("k long", [(1,), (2,), (None,), (None,)]), frame("k long", [(7,), (7,)])
    broken = frame("k long", [(1,)]).selectExpr("CAST(raise_error('bad text') AS bigint) AS k")
    path = str(tmp_path / "t")

    def check(df):
        return assert_unique_key(df, "k")

    assert replace_table(good, path, check) == 4
    for bad, error in ((repeated, DuplicateKeyError), (broken, Exception)):
        with pytest.raises(error):
            replace_table(bad, path, check)
        assert spark.read.parquet(path).count() == 4
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert replace_bucketed(good, "safe_load", "k", 2, check) == 4
    for bad, error in ((repeated, DuplicateKeyError), (broken, Exception)):
        with pytest.raises(error):
            replace_bucketed(bad, "safe_load", "k", 2, check)
        assert spark.table("safe_load").count() == 4
    assert replace_bucketed(frame("k long", [(5,)]), "safe_load", "k", 2, check) == 1
    spark.sql("DROP TABLE safe_load")


def test_every_file_of_an_entry_is_guarded(spark, tmp_path):
    for folder in ("mixed", "mixed/deep", "pages", "sub"):
        (tmp_path / folder).mkdir()
    land(tmp_path / "mixed/A.xpt", {"SEQN": [1.0, 2.0]})
    land(tmp_path / "mixed/deep/B.xpt", {"SEQN": [3.0]})
    for page in ("mixed/P.xpt", "pages/P.xpt", "sub/P.xpt"):
        (tmp_path / page).write_bytes(ERROR_PAGE)
    land(tmp_path / "P.xpt", {"SEQN": [9.0]})
    entries = [Entry("mixed", "m", ""), Entry("pages", "p", ""), Entry("sub/P.xpt", "s", ""), Entry("P.xpt", "t", "")]
    for target in (str(tmp_path / "out"), None):
        assert status_of(load_registry(spark, str(tmp_path), target, entries)) == {
            "mixed": ("m", "loaded", "download failed", 3),
            "pages": ("p", "failed", "download failed", None),
            "sub/P.xpt": ("s", "failed", "download failed", None),
            "P.xpt": ("t", "loaded", None, 1),
        }


def test_second_member_is_refused(spark, tmp_path):
    land(tmp_path / "A.xpt", {"SEQN": [1.0] * 40})
    whole = (tmp_path / "A.xpt").read_bytes()
    (tmp_path / "A.xpt").write_bytes(whole + whole[240:])
    status = load_registry(spark, str(tmp_path), None, [Entry("A.xpt", "a", "")], check_key=False)
    assert "more than one member" in status.first().reason
