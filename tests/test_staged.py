"""Extraction that appears whole or not at all."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from bindery.config import PackConfig
from bindery.operators.integrity import VerificationError, integrity_manifest
from bindery.plans.pack import pack_files
from bindery.plans.unpack import unpack_bundles
from bindery.sinks.files import extract_status
from bindery.sinks.staged import decide, extract_commit, finish_extractions, publish, stage

SCHEMA = "bundle string, path string, seq long, content binary"
ROWS = [
    ("", "a", 1, b"first"), ("", "a", 2, b"second"), ("b c", "d//p", 3, b"one"), ("b c", "d/./p", 4, b"two"),
    ("..", "x", 5, b"dots"), ("", "../up", 6, b"out"), ("", "f", 7, b"file"), ("", "f/g", 8, b"in folder"),
    ("", "none", 9, None), (None, "empty", 10, b""), ("", "/abs", 11, b"x"), ("", "n\u00e4me", 12, b"\xff\xfe"),
]


def frame(spark, rows=ROWS, parts=3):
    rows = [(b, p, s, None if c is None else bytearray(c)) for b, p, s, c in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_same_as_plain_extraction(spark, tmp_path):
    plain = extract_status(frame(spark), str(tmp_path / "plain")).collect()
    staged = extract_commit(frame(spark), f"file://{tmp_path}/staged").collect()
    assert sorted(map(str, staged)) == sorted(map(str, plain))
    assert tree(tmp_path / "staged") == tree(tmp_path / "plain")
    assert not [p for p in (tmp_path / "staged").iterdir() if p.name.startswith(".")]
    assert extract_commit(frame(spark, []), str(tmp_path / "nothing")).count() == 0


def test_rows_are_computed_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def note(batches):
        import uuid

        for batch in batches:
            for _ in range(len(batch)):
                (seen / uuid.uuid4().hex).touch()
            yield batch

    rows = frame(spark).mapInPandas(note, SCHEMA)
    extract_commit(rows, str(tmp_path / "out"))
    assert len(list(seen.iterdir())) == len(ROWS)


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    def die(batches):
        for batch in batches:
            yield batch
            if (batch["seq"] == 499).any():
                os.kill(os.getpid(), 9)

    rows = spark.range(0, 1000, 1, 4).selectExpr(
        "'' as bundle", "concat('f', id) as path", "id as seq", "cast('text' as binary) as content"
    )
    with pytest.raises(Exception):
        extract_commit(rows.mapInPandas(die, SCHEMA), str(tmp_path / "out"))
    assert tree(tmp_path) == {}


def test_attempts_that_do_not_count_are_not_listed(spark, tmp_path):
    staging = stage(frame(spark), str(tmp_path / "out"))
    lists = sorted((tmp_path / "out").glob(".staging-*/lists/*.parquet"))
    shutil.copy(lists[0], lists[0].with_name("0" * 32 + ".parquet"))
    lost = spark.read.parquet(str(lists[0])).withColumn("attempt", F.lit("lost"))
    lost.toPandas().to_parquet(lists[0].with_name("lost.parquet"))
    attempts = [r.attempt for r in spark.read.parquet(f"{staging.folder}/attempts").collect()]
    assert "lost" not in attempts
    again = stage(frame(spark), str(tmp_path / "out2"))
    assert again.listing.count() == len(ROWS)
    extra = spark.read.option("recursiveFileLookup", True).parquet(f"{staging.folder}/lists")
    assert extra.count() > len(ROWS)
    assert staging.listing.where("place is null").count() >= 1
    staging.discard()
    again.discard()
    assert not (tmp_path / "out").exists() and not (tmp_path / "out2").exists()


def test_a_lost_driver_is_made_good(spark, tmp_path):
    out = str(tmp_path / "out")
    staging = stage(frame(spark), out)
    decided = decide(staging, staging.listing)
    first = decided.where("status is null and path = 'a'").first()
    os.rename(f"{staging.folder}/{first.place}", f"{out}/a")  # moved before the driver was lost
    undecided = stage(frame(spark), out)
    assert finish_extractions(spark, out) == 1
    extract_commit(frame(spark), str(tmp_path / "whole"))
    assert tree(tmp_path / "out") == tree(tmp_path / "whole")
    assert not os.path.exists(undecided.folder)
    assert finish_extractions(spark, out) == 0 and finish_extractions(spark, str(tmp_path / "no")) == 0


def test_what_was_never_staged_has_failed(spark, tmp_path):
    staging = stage(frame(spark), str(tmp_path / "out"))
    decided = decide(staging, staging.listing)
    place = decided.where("path = 'a'").first().place
    os.remove(f"{staging.folder}/{place}")
    status = {r.path: r.status for r in publish(decided, str(tmp_path / "out"), staging.folder).collect()}
    assert status["a"] == "FAILED" and status["none"] == "FAILED" and status["f/g"] == "WRITTEN"


@pytest.fixture
def bundles(spark, tmp_path, make_files):
    def make(name, rows, **options):
        files = make_files([("b", p, t.encode()) for p, t in rows])
        pack_files(files, PackConfig(**options), str(tmp_path / name))
        return str(tmp_path / name / "bundles"), integrity_manifest(files)

    return make


def test_abort_refuses_missing_and_forged_files(spark, tmp_path, bundles):
    _, manifest = bundles("whole", [("a", "A\n"), ("b", "B\n")])
    forged, _ = bundles("forged", [("a", "A\n"), ("evil", "E\n")])
    out = tmp_path / "out"
    with pytest.raises(VerificationError, match="b in b is MISSING"):
        unpack_bundles(spark, forged, str(out), manifest=manifest)
    assert not out.exists()
    more, _ = bundles("more", [("a", "A\n"), ("b", "B\n"), ("evil", "E\n")])
    with pytest.raises(VerificationError, match="evil in b is UNSIGNED"):
        unpack_bundles(spark, more, str(out), manifest=manifest, unsigned="refuse")
    assert not out.exists()
    options = dict(manifest=manifest, on_fail="quarantine")
    assert unpack_bundles(spark, more, str(out), unsigned="refuse", **options) == 2
    assert tree(out) == {"a": b"A\n", "b": b"B\n"}
    assert unpack_bundles(spark, more, str(tmp_path / "kept"), **options) == 3


def test_abort_leaves_earlier_files(spark, tmp_path, bundles):
    first, manifest = bundles("first", [("a", "A\n")])
    assert unpack_bundles(spark, first, str(tmp_path / "out")) == 1
    second, _ = bundles("second", [("a", "changed\n"), ("b", "B\n")])
    with pytest.raises(VerificationError):
        unpack_bundles(spark, second, str(tmp_path / "out"), manifest=manifest)
    assert tree(tmp_path / "out") == {"a": b"A\n"}


def test_unsigned_headers_can_be_refused(spark, tmp_path, bundles):
    plain, _ = bundles("plain", [("a", "A\n")])
    with pytest.raises(VerificationError, match="UNSIGNED"):
        unpack_bundles(spark, plain, str(tmp_path / "out"), signed=True, unsigned="refuse")
    assert unpack_bundles(spark, plain, str(tmp_path / "out"), signed=True) == 1
    with pytest.raises(ValueError):
        unpack_bundles(spark, plain, str(tmp_path / "o2"), signed=True, unsigned="maybe")
    assert not (tmp_path / "o2").exists()
