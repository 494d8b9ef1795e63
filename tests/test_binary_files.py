"""Folders of files read by tasks, with the rows of Spark's own file source."""

import os

import pytest
from pyspark.sql import functions as F

from bindery.sources import content
from bindery.sources.content import read_binary_files

NAMES = [
    "a.txt", "_u", "_u=1", "_metadata.x", "_common_metadata", "x._COPYING_", "_metadata=1._COPYING_",
    ".h", "empty", "sp ace%20.tar.gz", "sub/b", "_sub/b", "_sub=1/b", "_metadata/b", "_metadata/_c",
    "sub/.hid/b", "y._COPYING_/b", "_metadata._COPYING_/z", "sub/_q/b", "deep/er/c.md", "é/d",
]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in NAMES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "empty" else f"in {name}")
    (root / "link").symlink_to(root / "deep")
    (root / "file").symlink_to(root / "a.txt")
    (root / "broken").symlink_to(root / "nowhere")
    return str(root)


def rows(files):
    return sorted((r.path, r.size, bytes(r.content)) for r in files.collect())


def by_spark(spark, paths):
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return rows(source.withColumnRenamed("length", "size"))


@pytest.mark.parametrize(
    "scheme, below",
    [("", [""]), ("file:", ["/sub", "", "/"]), ("file://", ["/_sub", "/_sub/b", "/_u", "/.h"]),
     ("file:", ["/sp ace%20.tar.gz", "/a.txt", "/a.txt", "//sub/../deep/"]), ("", ["/s*"])],
)
def test_rows_are_those_of_the_file_source(spark, tree, scheme, below):
    paths = [f"{scheme}{tree}{b}" for b in below]
    got = read_binary_files(spark, paths[0] if len(paths) == 1 else paths)
    assert got.columns == ["path", "size", "content", "base_name", "ext"]
    assert rows(got) == by_spark(spark, paths)


def test_missing_path_raises(spark, tree):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_binary_files(spark, [tree, f"{tree}/gone"])


def test_files_are_not_listed_or_planned_by_the_driver(spark, tmp_path):
    """Many small files: the source made a task of each few and held all names."""
    for i in range(400):
        (tmp_path / f"{i % 4}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 4}" / f"{i}.c").write_text(f"text {i}")
    read = read_binary_files(spark, str(tmp_path))
    assert not [f for f in read.inputFiles() if f.endswith(".c")]
    assert read.rdd.getNumPartitions() == 8  # the session's width
    assert {r.base_name: bytes(r.content) for r in read.collect()} == {
        f"{i}.c": f"text {i}".encode() for i in range(400)
    }


def test_only_what_is_asked_for_is_read(spark, tree, capsys):
    read = read_binary_files(spark, tree)
    read.select("path", "size").explain()
    assert "Python" not in capsys.readouterr().out
    os.remove(f"{tree}/deep/er/c.md")  # once more as link/er/c.md
    assert read.count() == read.select("path").distinct().count() == len(by_spark(spark, tree)) + 2
    kept = read.filter(~F.col("path").endswith("c.md") & (F.col("size") < 100))
    assert rows(kept) == by_spark(spark, tree)
    with pytest.raises(Exception, match="c.md"):
        read.collect()


def test_batches_are_cut_by_bytes(spark, tree, monkeypatch):
    monkeypatch.setattr(content, "_BATCH_BYTES", 20)
    assert rows(read_binary_files(spark, tree)) == by_spark(spark, tree)


def test_checksums_beside_a_file_are_compared(spark, tmp_path):
    out = tmp_path / "out"
    spark.range(2000).selectExpr("cast(id as string) as value").coalesce(1).write.text(str(out))
    assert rows(read_binary_files(spark, str(out))) == by_spark(spark, str(out))
    (part,) = out.glob("part-*")
    part.write_bytes(part.read_bytes().replace(b"1999", b"1998"))
    for read in (by_spark, lambda s, p: read_binary_files(s, p).collect()):
        with pytest.raises(Exception, match="(?i)checksum|FAILED_READ_FILE"):
            read(spark, str(out))
