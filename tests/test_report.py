"""What a run says of the files it did not pack."""

import pytest
from pyspark.sql import functions as F

from bindery.config import PackConfig
from bindery.operators import admission
from bindery.plans import pack
from bindery.plans.pack import NoInputError, pack_files, pack_manifest, pack_paths
from bindery.sources.tables import files_from_table
from bindery.sources.walk import catalog


def report_of(spark, out):
    return {r.reason: (r.files, r.bytes) for r in spark.read.parquet(f"{out}/report").collect()}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, text in (("a.c", "x\n"), ("b.log", "four\n"), ("c.log", "y\n")):
        (root / name).write_text(text)
    return root


def test_paths_report_reasons_and_missing_arguments(spark, tmp_path, tree):
    out = f"{tmp_path}/out"
    pack_paths(spark, [str(tree), f"{tmp_path}/gone"], PackConfig(skip_patterns=("*.log",)), out, "n")
    assert report_of(spark, out) == {"OK": (1, 2), "SKIP": (2, 7), "MISSING": (1, 0)}


def test_manifest_reports_names_without_a_file(spark, tmp_path, tree):
    out = f"{tmp_path}/out"
    tracked = spark.createDataFrame([("a.c",), ("z.c",), ("z.c",)], "path string")
    pack_manifest(spark, str(tree), tracked, PackConfig(), out, "n")
    assert report_of(spark, out) == {"OK": (1, 2), "MISSING": (2, 0)}


def test_report_is_there_when_nothing_matches(spark, tmp_path, make_files):
    out = f"{tmp_path}/out"
    with pytest.raises(NoInputError):
        pack_files(make_files([("b", ".x", b"1")]), PackConfig(), out)
    assert report_of(spark, out) == {"DOT": (1, 1)}


@pytest.mark.parametrize("gone", [["b.c"], ["a.c", "b.c"]])
def test_failed_reads_are_unreadable_in_the_report(spark, tmp_path, gone):
    """Files that are gone when they are read count as UNREADABLE, with their bytes."""
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for name, text in (("a.c", "aa"), ("b.c", "bbbb"), ("c.md", "c")):
        (root / name).write_text(text)
    cfg = PackConfig(types="c")
    listed = catalog(spark, [str(root)], "x")
    for name in gone:
        (root / name).unlink()
    if len(gone) == 2:
        with pytest.raises(pack.NoInputError):
            pack._pack_catalog(listed, cfg, out, 1)
    else:
        assert pack._pack_catalog(listed, cfg, out, 1)["failed"] == 1
    got = {r.reason: (r.files, r.bytes) for r in spark.read.parquet(f"{out}/report").collect()}
    lost = {"a.c": 2, "b.c": 4}
    expected = {"TYPE": (1, 1), "MISSING": (1, 0),
                "UNREADABLE": (len(gone), sum(lost[n] for n in gone)), "OK": (1, 2)}
    if len(gone) == 2:
        del expected["OK"]
    assert got == expected


def test_a_stored_size_does_not_stand_for_content(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None, 7), (2, "b", "x", 1)],
                                 "seq long, path string, text string, n long")
    files = files_from_table(rows, F.col("path"), F.col("text"), F.col("seq"), size=F.col("n"))
    reasons = {r.seq: r.reason for r in admission.with_reason(files, PackConfig()).collect()}
    assert reasons == {1: "UNREADABLE", 2: "OK"}
    assert admission.admit(files, PackConfig()).count() == 1
    rows.write.parquet(str(tmp_path / "t"))
    stored = files_from_table(spark.read.parquet(str(tmp_path / "t")), F.col("path"), F.col("text"),
                              F.col("seq"), size=F.col("n"), complete=True)
    plan = stored.select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
