"""Frames found by their index, and nothing else read."""

from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

import model
from bindery.operators import packing
from bindery.sinks.bundles import write_planned
from bindery.sources.bundles import read_bundles
from bindery.sources.frame_index import index_frames, read_frames


def where(uri):
    return Path(unquote(urlparse(uri).path))


@pytest.fixture
def bundles(make_files, tmp_path):
    rows = [
        (("a/b=c", "007", "", "ü d")[i % 4], f"p{i}é", ("x" * (i % 5) + f"é{i}\n" * (i % 90)).encode())
        for i in range(300)
    ] + [("007", "binary", b"\x01" * 600)]
    files, out = make_files(rows), tmp_path / "out"
    write_planned(*packing.assign_tasks(packing.render(files), files, 900, 3000), str(out))
    return str(out)


def told(df):
    return sorted((r.bundle, r.path or "", r.signature or "", r.kind, r.body or "") for r in df.collect())


@pytest.mark.parametrize("split", ["300", "128m"])
def test_index_names_every_record(spark, bundles, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        index = index_frames(spark, bundles).collect()
        every = told(read_bundles(spark, bundles))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(index) == len(every) == 301
    for r in index:
        data = where(r.file).read_bytes()
        assert data[r.offset - 7 : r.offset] == b"'''--- "
        assert data[r.offset :].startswith(f"{r.path} ---".encode())
        end = r.offset + r.length
        assert end == len(data) or data[end : end + 8] == b"\n'''--- "
    assert told(read_frames(index_frames(spark, bundles))) == every


def test_only_the_named_bytes_are_read(spark, bundles, tmp_path):
    every = {r[1]: r for r in told(read_bundles(spark, bundles))}
    index_frames(spark, bundles).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    some = index.where(F.crc32("path") % 9 == 0)
    listed = {}
    for r in some.collect():
        listed.setdefault(r.file, []).append((r.offset, r.length))
    for file in {r.file for r in index.select("file").collect()}:
        data = where(file).read_bytes()
        kept = bytearray(b"?" * len(data))  # all that is not listed is lost
        for offset, length in listed.get(file, []):
            kept[offset : offset + length] = data[offset : offset + length]
        where(file).write_bytes(kept)
    got = told(read_frames(some))
    assert got == sorted(every[r.path] for r in some.collect()) and len(got) > 10
    assert read_frames(index.where("false")).count() == 0


def test_foreign_files(spark, tmp_path):
    """Text before the first header, a mark of UTF-8, a broken header, a cut file, no frame."""
    text = model.pack([("one", b"1\n"), ("two", "zwei ü\n".encode())]).encode()
    forms = {
        "plain": text, "before": b"words\n\nmore\n" + text, "mark": b"\xef\xbb\xbf" + text,
        "broken": text + b"'''--- no end\nbody\n", "cut": text + b"\n'''--- ", "none": b"words\n",
        "empty": b"",
    }
    for name, data in forms.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "bundle.txt").write_bytes(data)
        every = told(read_bundles(spark, str(folder), foldered=False))
        assert told(read_frames(index_frames(spark, str(folder), foldered=False))) == every, name


def test_short_files_end_the_job(spark, bundles):
    index = index_frames(spark, bundles)
    index.count()
    for part in Path(bundles).rglob("part-*"):
        part.write_bytes(part.read_bytes()[:-40])
    with pytest.raises(Exception, match="shorter than its index"):
        read_frames(index).collect()
