import base64
import hashlib
import hmac
import os

import pytest
from pyspark.sql import functions as F

import model
from bindery.functions import integrity as digests
from bindery.operators import integrity, packing, unpacking

KEY = b"k" * 100


def test_keyed_digest_is_hmac(evaluate):
    texts = [b"", b"abc", os.urandom(5000)]
    for key in (b"", b"short", b"x" * 64, KEY):
        got = evaluate(digests.keyed_digest(F.col("x"), key), texts, "binary")
        assert got == [hmac.new(key, t, hashlib.sha256).hexdigest() for t in texts]


def test_signature_is_base64_of_digest(evaluate):
    got = evaluate(digests.signature(F.col("x")), ["abc"])
    assert got == [base64.b64encode(hashlib.sha256(b"abc").digest()).decode()]
    checks = [got[0], "QUJD", "?", None]
    assert evaluate(digests.is_digest(F.col("x")), checks) == [True, False, False, False]


ROWS = [
    ("b", "plain", b"one\n"), ("b", "crlf", b"a\r\nb\r\n\r\n\r\n\r\n\r\nc"), ("b", "bin", b"\0" * 9),
    ("b", "bytes", b"\xff\xfe text"), ("b", "empty", b""), ("b", "twice", b"old"),
    ("b", "twice", b"new"),
]


def test_manifest_covers_text_files_only(make_files):
    manifest = integrity.integrity_manifest(make_files(ROWS)).orderBy("seq").collect()
    assert [r.path for r in manifest] == ["plain", "crlf", "bytes", "empty", "twice", "twice"]
    for row, (_, _, data) in zip(manifest, [r for r in ROWS if r[1] != "bin"], strict=True):
        body = model.squeeze(model.text_of(data) + "\n")
        assert row.sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert row.raw_sha256 == hashlib.sha256(data).hexdigest()
        assert row.size == len(data)


def test_untouched_bundle_verifies(make_files):
    """Also where line ends, blank runs or bad bytes changed on the way in."""
    files = make_files(ROWS)
    for key in (None, KEY):
        unpacked = unpacking.unpack(packing.pack(files, signed=True, key=key))
        manifest = integrity.integrity_manifest(files, key)
        status = integrity.verify(integrity.frame_digests(unpacked, key), manifest).collect()
        assert {r.status for r in status} == {"OK"} and len(status) == 5
        signed = integrity.verify_signatures(unpacked, key).collect()
        assert {r.status for r in signed} == {"OK"} and len(signed) == 6
        wrong = integrity.verify_signatures(unpacked, b"other").collect()
        assert {r.status for r in wrong} == {"MISMATCH"}


def test_unsqueezed_bundle_verifies(make_files):
    files = make_files(ROWS)
    unpacked = unpacking.unpack(packing.pack(files, squeezed=False, signed=True))
    assert {r.status for r in integrity.verify_signatures(unpacked).collect()} == {"OK"}
    manifest = integrity.integrity_manifest(files, squeezed=False)
    status = integrity.verify(integrity.frame_digests(unpacked), manifest).collect()
    assert {r.status for r in status} == {"OK"}


def test_every_status(make_files, spark):
    files = make_files([("b", p, p.encode()) for p in ("same", "changed", "lost", "extra")])
    manifest = integrity.integrity_manifest(files).filter("path <> 'extra'")
    unpacked = unpacking.unpack(packing.pack(files)).filter("path <> 'lost'").withColumn(
        "body", F.when(F.col("path") == "changed", "x\n").otherwise(F.col("body")))
    status = integrity.verify(integrity.frame_digests(unpacked), manifest)
    assert {r.path: r.status for r in status.collect()} == {
        "same": "OK", "changed": "MISMATCH", "lost": "MISSING", "extra": "UNSIGNED"}
    assert {r.status: r.n for r in integrity.status_counts(status).collect()} == {
        "OK": 1, "MISMATCH": 1, "MISSING": 1, "UNSIGNED": 1}
    with pytest.raises(integrity.VerificationError):
        integrity.extract_policy(status, "abort")
    good, bad = integrity.extract_policy(status, "quarantine")
    assert sorted(r.path for r in good.collect()) == ["extra", "same"]
    assert [r.path for r in bad.collect()] == ["changed"]
    with pytest.raises(ValueError):
        integrity.extract_policy(status, "ignore")


def test_header_signatures(spark, make_files):
    text = packing.pack(make_files([("b", "p", b"x")]), signed=True).collect()[0].text
    variants = {
        "OK": text, "MISMATCH": text.replace("\nx\n", "\ny\n"),
        "UNSIGNED": model.pack([("p", b"x")]),
        "UNCHECKED": "'''--- p --- [SIGNATURE:" + "QUJD" * 21 + "QQ==]\nx\n'''\n\n",
    }
    df = spark.createDataFrame(list(variants.items()), "bundle string, text string")
    checked = integrity.verify_signatures(unpacking.unpack(df)).collect()
    assert {r.bundle: r.status for r in checked} == {k: k for k in variants}


def test_hot_path_joins_once(spark):
    """A path copied many times on both sides gives one row, not all pairs."""
    many = spark.range(3000).select(
        F.lit("b").alias("bundle"), F.col("id").alias("seq"), F.lit("p").alias("path"),
        F.col("id").cast("string").alias("sha256"))
    assert [tuple(r) for r in integrity.verify(many, many).collect()] == [("b", "p", "OK")]
