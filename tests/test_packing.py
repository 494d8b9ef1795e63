import hashlib
import random

from pyspark.sql import functions as F

import model
from bindery.operators import packing, unpacking
from bindery.sinks.bundles import write_bundles
from bindery.sources.bundles import read_bundles


def corpus(seed=11, n=160):
    """Files of every kind in three bundles, two thirds of them in one."""
    rng = random.Random(seed)
    pieces = ["word ", "\n", "\n\n\n\n", "\r\n", "  \n", "é", "''' x", "\t"]
    rows = []
    for i in range(n):
        data = "".join(rng.choices(pieces, k=rng.randint(0, 60))).encode()
        if i % 9 == 0:
            data = b"\0\1" * 40 + data
        if i % 13 == 0:
            data += b"\xff"
        if i % 17 == 0:
            data = b""
        rows.append((rng.choice(["hot", "hot", "hot", "hot", "b", "c d=é"]), f"d/{i:03} f.txt", data))
    return rows


def by_bundle(rows):
    out = {}
    for bundle, path, data in rows:
        out.setdefault(bundle, []).append((path, data))
    return out


def joined(packed):
    texts = {}
    for r in packed.orderBy("bundle", "shard").collect():
        texts[r.bundle] = texts.get(r.bundle, "") + r.text
    return texts


def test_pack_equals_model_for_any_shard_size(make_files):
    rows = corpus()
    files = make_files(rows)
    expected = {b: model.pack(f) for b, f in by_bundle(rows).items()}
    for budget in (1, 700, 5000, 10**9):
        packed = packing.pack(files, budget)
        assert joined(packed) == expected
        sizes = packed.select(
            (F.octet_length("text") == F.col("n_bytes")).alias("ok"), "n_files").collect()
        assert all(r.ok for r in sizes) and sum(r.n_files for r in sizes) == len(rows)


def test_shards_are_bounded(make_files):
    rows = corpus()
    files, budget = make_files(rows), 700
    largest = max(len(d) + len(p) for _, p, d in rows) + 40
    for r in packing.pack(files, budget).collect():
        assert r.n_bytes <= budget + largest


def test_plan_and_cuts_agree(make_files):
    files = make_files(corpus())
    plan = packing.shard_plan(files, 500)
    assigned = packing.assign_shards(files, files, 500, span=16)
    assert sorted(map(tuple, plan.collect())) == sorted(
        map(tuple, assigned.select("bundle", "seq", "shard").collect()))


def test_empty_files_still_fill_shards(make_files):
    files = make_files([("b", f"f{i}", b"") for i in range(50)])
    assert packing.shard_plan(files, 100).select("shard").distinct().count() > 5


def test_unpack_inverts_pack(make_files):
    rows = corpus()
    packed = packing.pack(make_files(rows), 900)
    restored = unpacking.restore(unpacking.unpack(packed))
    got = {}
    for r in restored.orderBy("bundle", "seq").collect():
        got.setdefault(r.bundle, []).append((r.path, r.content))
    expected = {b: model.unpack(model.pack(f)) for b, f in by_bundle(rows).items()}
    assert got == expected
    for bundle, files in by_bundle(rows).items():
        texts = [(p, d) for p, d in files if not model.is_binary(d)]
        assert [p for p, _ in got[bundle]] == [p for p, _ in texts]


def test_bundle_files_round_trip(spark, make_files, tmp_path):
    """Part files in name order are the packed text; reading splits them."""
    rows = corpus(n=300)
    files, out = make_files(rows), str(tmp_path / "out")
    write_bundles(packing.assign_shards(packing.render(files), files, 2000), out)
    for bundle, members in by_bundle(rows).items():
        folder = next(
            p for p in (tmp_path / "out").iterdir()
            if p.name == "bundle=" + bundle.replace("=", "%3D"))
        parts = [f for s in sorted(folder.iterdir()) for f in sorted(s.glob("part-*"))]
        assert "".join(p.read_bytes().decode() for p in parts) == model.pack(members)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = unpacking.restore(read_bundles(spark, out))
        got = {}
        for r in read.orderBy("bundle", "pos").collect():
            got.setdefault(r.bundle, []).append((r.path, r.content))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {b: model.unpack(model.pack(f)) for b, f in by_bundle(rows).items()}


def test_bundle_names_keep_their_text(spark, make_files, tmp_path):
    names = ["", "007", "1e3", "a/b=c"]
    files, out = make_files([(n, "p", b"x") for n in names]), str(tmp_path / "out")
    write_bundles(packing.assign_shards(packing.render(files), files), out)
    assert sorted(r.bundle for r in read_bundles(spark, out).collect()) == names


def test_plain_file_is_read_as_its_own_bundle(spark, tmp_path):
    path = tmp_path / "one.txt"
    path.write_text("'''--- PUBLIC_KEY --- [KEY:QUJD]\n'''\n\n" + model.pack([("p", b"x")]))
    rows = {r.kind: r for r in read_bundles(spark, str(path), foldered=False).collect()}
    assert rows["text"].path == "p" and rows["text"].body == "x\n"
    assert rows["key"].body == "QUJD" and rows["key"].bundle.endswith("one.txt")


def test_unpack_ignores_what_lies_between_frames(spark):
    text = ("preamble\n'''--- a ---\nx\n'''\n\nnoise\n'''--- b ---\n"
            + model.MARKER + "\nmore noise\n'''--- broken\n'''--- c --- [SIGNATURE:s]\ny")
    df = spark.createDataFrame([("b", text)], "bundle string, text string")
    rows = [(r.path, r.signature, r.kind, r.body)
            for r in unpacking.unpack(df).orderBy("seq").collect()]
    assert rows == [
        ("a", None, "text", "x\n"), ("b", None, "binary", None),
        (None, None, "bad_header", ""), ("c", "s", "text", "y\n"),
    ]
    counts = unpacking.extract_counts(unpacking.unpack(df)).collect()[0]
    assert (counts.extracted, counts.binary, counts.bad_header) == (2, 1, 1)


def test_windows_line_ends(spark, tmp_path):
    path, text = tmp_path / "b.txt", model.pack([("p", b"x\n\ny"), ("z", b"\0"), ("q", b"w")])
    path.write_bytes(text.replace("\n", "\r\n").encode())
    df = spark.createDataFrame([("b", path.read_bytes().decode())], "bundle string, text string")
    for unpacked in (unpacking.unpack(df), read_bundles(spark, str(path), foldered=False)):
        rows = unpacking.restore(unpacked).collect()
        assert {r.path: r.content for r in rows} == {"p": "x\n\ny\n", "q": "w\n"}


def test_marker_inside_a_text_is_text(make_files):
    data = f"a\n{model.MARKER}\nb\n".encode()
    rows = unpacking.restore(
        unpacking.unpack(packing.pack(make_files([("b", "p", data), ("b", "q", b"z")])))).collect()
    assert {r.path: r.content for r in rows} == {"p": data.decode(), "q": "z\n"}


def test_no_frames_is_an_error(spark):
    import pytest

    df = spark.createDataFrame([("b", "nothing here")], "bundle string, text string")
    with pytest.raises(unpacking.EmptyBundleError):
        unpacking.require_files(unpacking.unpack(df))


def test_key_blocks(spark):
    import base64

    good = base64.b64encode(bytes(32)).decode()
    text = "".join(f"'''--- PUBLIC_KEY --- [KEY:{k}]\n'''\n\n" for k in (good, "QUJD", "?!"))
    df = spark.createDataFrame([("b", text)], "bundle string, text string")
    rows = {r.key: r.valid for r in unpacking.key_blocks(unpacking.unpack(df)).collect()}
    assert rows == {good: True, "QUJD": False, "?!": False}


def test_last_wins(spark):
    rows = [("b", f"p{i % 5}", i, f"v{i}") for i in range(1000)] + [("c", "p0", 1, "only")]
    df = spark.createDataFrame(rows, "bundle string, path string, seq long, content string")
    got = {(r.bundle, r.path): (r.seq, r.content)
           for r in unpacking.last_wins(df.repartition(7)).collect()}
    assert got == {**{("b", f"p{i}"): (995 + i, f"v{995 + i}") for i in range(5)},
                   ("c", "p0"): (1, "only")}


def test_audit_finds_what_does_not_round_trip(make_files):
    rows = corpus() + [("hot", "x1", b"a\n'''\nb\n"), ("hot", "x2", b"'''--- y ---\n"),
                       ("hot", "x3", model.MARKER.encode() + b"\nz"), ("hot", "x4", b"fine\n")]
    texts = [(b, p, d) for b, p, d in rows if not model.is_binary(d)]
    audit = {r.path: r for r in unpacking.bundle_audit(make_files(texts)).collect()}
    for _, path, data in texts:
        single = model.unpack(model.pack([(path, data)]))
        lossless = single == [(path, data.decode("utf-8", "replace"))]
        flagged = audit[path].collides or audit[path].lossy
        assert flagged == (not lossless), path
    assert [audit[p].collides for p in ("x1", "x2", "x3", "x4")] == [True, True, True, False]


def test_digest_of_pack_matches(make_files):
    rows = corpus(n=30)
    packed = packing.pack(make_files(rows)).select("bundle", F.sha2("text", 256).alias("d"))
    assert {r.bundle: r.d for r in packed.collect()} == {
        b: hashlib.sha256(model.pack(f).encode()).hexdigest() for b, f in by_bundle(rows).items()}
