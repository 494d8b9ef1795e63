"""Whole runs on real trees."""

import os

import pytest
from pyspark.sql import functions as F

import model
from bindery import PackConfig
from bindery.operators.integrity import VerificationError
from bindery.plans.pack import NoInputError, pack_files, pack_manifest, pack_paths
from bindery.plans.unpack import unpack_bundles
from bindery.sinks.files import extract_files, extract_status, split_safe
from bindery.sources.content import read_binary_files, read_content
from bindery.sources.walk import _LISTING, _walk, catalog, catalog_paths, catalog_walk
from bindery.streaming.pack import pack_stream


def build(root, files):
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


def bundle_text(out):
    parts = sorted((p for p in (out / "bundles").rglob("part-*")), key=str)
    return "".join(p.read_bytes().decode() for p in parts)


def headers(out):
    return [line for line in bundle_text(out).split("\n") if line.startswith("'''--- ")]


NESTED = {
    "test1.c": "int a;\n", "test1.h": "int b;\n", "notes.txt": "notes\n", "readme.md": "# r\n",
    "dir1/nested.c": "c\n", "dir1/nested.h": "h\n", "dir1/subdir/deep.c": "d\n",
    "dir2/other.c": "o\n",
}


def pack(spark, tmp_path, files, roots=("",), **settings):
    source = build(tmp_path / "in", files)
    out = tmp_path / "out"
    counters = pack_paths(
        spark, [os.path.join(source, r) if r else source for r in roots],
        PackConfig(**settings), str(out), "run")
    return out, counters


def test_name_pattern(spark, tmp_path):
    flat = {"test1.c": "a", "test2.c": "b", "helper.h": "c", "readme.md": "d"}
    out, counters = pack(spark, tmp_path, flat, name_pattern="test*.c")
    assert len(headers(out)) == 2 and counters["files"] == 2 and counters["failed"] == 0


def test_type_filter(spark, tmp_path):
    out, _ = pack(spark, tmp_path, NESTED, types=".h")
    assert [h.split("/")[-1] for h in headers(out)] == ["nested.h ---", "test1.h ---"]


def test_recursion_and_path_order(spark, tmp_path):
    out, _ = pack(spark, tmp_path, NESTED, types="c")
    found = [h[len("'''--- ") : -len(" ---")] for h in headers(out)]
    assert found == sorted(found) and len(found) == 4


def test_without_recursion_a_directory_is_left_out(spark, tmp_path):
    roots = ["dir1", "test1.c"]
    out, _ = pack(spark, tmp_path, NESTED, roots, recursive=False)
    assert len(headers(out)) == 1
    with pytest.raises(NoInputError):
        pack_paths(spark, [str(tmp_path / "in/dir1")], PackConfig(recursive=False),
                   str(tmp_path / "none"), "run")


def test_argument_order_and_exact_bytes(spark, tmp_path):
    files = {"test1.c": "This is a C file\n", "test1.h": "This is a header file\n"}
    out, _ = pack(spark, tmp_path, files, roots=["test1.h", "test1.c", "test1.h"])
    base = str(tmp_path / "in")
    order = ["test1.h", "test1.c", "test1.h"]
    expected = model.pack([(f"{base}/{n}", files[n].encode()) for n in order])
    assert bundle_text(out) == expected
    assert len(expected.splitlines()) == 15  # five lines a frame


@pytest.mark.parametrize("shown", [False, True])
def test_dot_files(spark, tmp_path, shown):
    files = {"regular.txt": "r", ".dotfile": "d", ".config": "c", ".dir/inner.txt": "i"}
    out, _ = pack(spark, tmp_path, files, include_hidden=shown)
    assert len(headers(out)) == (4 if shown else 1)


def test_skip_patterns(spark, tmp_path):
    files = {"keep_file.txt": "k", "skip_me.log": "s", "subdir/nested_keep.rs": "n",
             "subdir/skip_me.tmp": "t"}
    out, _ = pack(spark, tmp_path, files, skip_patterns=("*.log", "*.tmp"))
    assert [h.split("/")[-1] for h in headers(out)] == ["keep_file.txt ---", "nested_keep.rs ---"]


def test_output_folder_is_not_read_back(spark, tmp_path):
    source = build(tmp_path, {"a.txt": "a"})
    for name in ("one", "two"):
        out = tmp_path / "out"
        listed = catalog_walk(spark, [source], exclude=[str(out)])
        assert [r.base_name for r in listed.collect()] == ["a.txt"]
        pack_paths(spark, [source], PackConfig(), str(out / name), name)
        # each run excludes only its own folder; the parent is excluded above


def test_unpack_restores_files(spark, tmp_path):
    files = {f"t{i}.txt": f"This is file {i}\n" * i for i in range(1, 4)}
    files["sub/t4.txt"] = "In a subdirectory\n"
    out, _ = pack(spark, tmp_path, files)
    prefix = str(tmp_path / "in") + "/"
    written = unpack_bundles(
        spark, str(out / "bundles"), str(tmp_path / "back"), prefix=prefix)
    assert written == 4
    for name, text in files.items():
        assert (tmp_path / "back" / name).read_text() == text


def test_unsafe_headers_are_not_written(spark, tmp_path):
    out, _ = pack(spark, tmp_path, {"a": "x"})
    assert unpack_bundles(spark, str(out / "bundles"), str(tmp_path / "back")) == 0


@pytest.mark.parametrize("key", [None, b"secret"])
def test_signed_run_detects_change(spark, tmp_path, key):
    files = {f"s{i}.txt": f"text {i}\r\n\n\n\n\nend" for i in range(3)}
    out, _ = pack(spark, tmp_path, files, signed=True, key=key)
    prefix = str(tmp_path / "in") + "/"
    manifest = spark.read.parquet(str(out / "manifest"))
    options = dict(manifest=manifest, signed=True, key=key, prefix=prefix)
    assert unpack_bundles(spark, str(out / "bundles"), str(tmp_path / "b1"), **options) == 3
    part = next((out / "bundles").rglob("part-*"))
    part.write_text(part.read_text().replace("text 1", "text X"))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(VerificationError):
        unpack_bundles(spark, str(out / "bundles"), str(tmp_path / "b2"), **options)
    assert not (tmp_path / "b2").exists()
    unsigned = {**options, "signed": False}
    with pytest.raises(VerificationError):
        unpack_bundles(spark, str(out / "bundles"), str(tmp_path / "b2"), **unsigned)
    for options in (options, unsigned):
        back = tmp_path / f"b3{options['signed']}"
        kept = unpack_bundles(
            spark, str(out / "bundles"), str(back), on_fail="quarantine", **options)
        assert kept == 2 and not (back / "s1.txt").exists()


def test_tracked_list(spark, tmp_path):
    files = {"test.c": "int\n", "README.md": "r\n", "subdir/another.c": "c\n", ".ci/x.yml": "y\n",
             "untracked.c": "u\n"}
    root = build(tmp_path / "repo", files)
    names = ["test.c", "README.md", "subdir/another.c", ".ci/x.yml", "gone.c", "test.c"]
    tracked = spark.createDataFrame([(n,) for n in names], "path string")
    pack_manifest(spark, root, tracked, PackConfig(), str(tmp_path / "out"), "repo_main")
    found = sorted(h[len(f"'''--- {root}/") : -len(" ---")] for h in headers(tmp_path / "out"))
    assert found == [".ci/x.yml", "README.md", "subdir/another.c", "test.c", "test.c"]


def test_nothing_admitted(spark, tmp_path):
    with pytest.raises(NoInputError):
        pack(spark, tmp_path, {"a.c": "x"}, types="py")


def test_pack_table_files(make_files, tmp_path):
    rows = [("b", "p", b"x"), ("b", ".hidden", b"y"), ("c", "q", b"\0\0")]
    counters = pack_files(make_files(rows), PackConfig(), str(tmp_path / "out"))
    assert counters["files"] == 2 and counters["binary"] == 1
    with pytest.raises(NoInputError):
        pack_files(make_files(rows), PackConfig(max_bytes=0), str(tmp_path / "none"))


TREE = {"x.c": "x", "a/e.txt": "", "a/.h/z.c": "z", "b/.dot": "d", "b/c/_u.md": "u"}


def test_walk_tree(spark, tmp_path):
    root = build(tmp_path / "t", TREE)

    def walk(**options):
        rows = catalog_walk(spark, [root], **options).collect()
        return {os.path.relpath(r.path, root): r for r in rows}

    assert sorted(walk()) == ["a/e.txt", "b/c/_u.md", "x.c"]
    shown = walk(include_hidden=True)
    assert sorted(shown) == sorted(TREE)
    assert {p for p, r in shown.items() if r.hidden_tree} == {"a/.h/z.c", "b/.dot"}
    assert shown["a/e.txt"].size == 0 and shown["b/c/_u.md"].base_name == "_u.md"
    assert sorted(walk(exclude=[f"{root}/b"])) == ["a/e.txt", "x.c"]
    assert walk(recursive=False) == {}
    read = {r.base_name: bytes(r.content)
            for r in read_content(catalog_walk(spark, [root])).collect()}
    assert read == {"x.c": b"x", "e.txt": b"", "_u.md": b"u"}
    by_source = {r.base_name for r in read_binary_files(spark, root).collect()}
    assert by_source == {"x.c"}  # the file source leaves the others out


def test_walk_follows_links_but_not_in_circles(spark, tmp_path):
    root = build(tmp_path / "t", {"a/f": "1", "b/g": "2"})
    (tmp_path / "t/a/up").symlink_to(tmp_path / "t")
    (tmp_path / "t/a/self").symlink_to(tmp_path / "t/a")
    (tmp_path / "t/a/x").symlink_to(tmp_path / "t/b")
    (tmp_path / "t/b/y").symlink_to(tmp_path / "t/a")
    (tmp_path / "t/link").symlink_to(tmp_path / "t/b/g")
    (tmp_path / "t/broken").symlink_to(tmp_path / "nowhere")
    found = sorted(os.path.relpath(r.path, root) for r in catalog_walk(spark, [root]).collect())
    assert found == ["a/f", "a/x/g", "b/g", "b/y/f", "link"]


def test_explicit_paths(spark, tmp_path):
    root = build(tmp_path / "t", {"a": "1", ".b": "22"})
    paths = [f"{root}/a", f"{root}/gone", root, f"{root}/.b", f"{root}/a"]
    rows = catalog_paths(spark, paths).orderBy("arg").collect()
    assert [(r.exists, r.is_file, r.size) for r in rows] == [
        (True, True, 1), (False, False, None), (True, False, None), (True, True, 2),
        (True, True, 1)]
    mixed = catalog(spark, paths, "b").orderBy("seq").collect()
    assert [(r.arg, r.base_name) for r in mixed] == [(0, "a"), (2, "a"), (3, ".b"), (4, "a")]


def test_unreadable_directory(spark, tmp_path):
    root = build(tmp_path / "t", {"a/f": "1"})
    gone = spark.createDataFrame(
        [(0, f"{root}/a", "dir", None, None, False, os.fsencode(f"{root}/a"), [], None),
         (0, f"{root}/missing", "dir", None, None, False, os.fsencode(f"{root}/missing"), [], None)],
        _LISTING)

    assert _walk(gone, False, [], "skip").count() == 1
    with pytest.raises(Exception, match="missing"):
        _walk(gone, False, [], "raise").count()


def test_failed_read_is_marked(spark, tmp_path):
    root = build(tmp_path / "t", {"a": "1", "b": "2"})
    listed = catalog(spark, [root], "x")
    (tmp_path / "t/b").unlink()
    rows = {r.base_name: (r.content, r.failed) for r in read_content(listed).collect()}
    assert rows == {"a": (b"1", False), "b": (None, True)}


def test_extract_is_last_wins_and_safe(spark, tmp_path):
    rows = [("", "d/p", 1, "old"), ("", "d/p", 5, "new"), ("", "../out", 2, "bad"),
            ("", "/abs", 3, "bad"), ("", "q", 4, "q")]
    df = spark.createDataFrame(rows, "bundle string, path string, seq long, content string")
    assert extract_files(df, str(tmp_path / "o")) == 2
    found = {str(p.relative_to(tmp_path)): p.read_text()
             for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"o/d/p": "new", "o/q": "q"}
    safe, unsafe = split_safe(df)
    assert (safe.count(), unsafe.count()) == (3, 2)


def test_extraction_goes_on_after_odd_paths(spark, tmp_path):
    rows = [("..", "a", 1, "in"), ("", "x//y", 2, "old"), ("", "./x/./y", 3, "new"), ("", "x", 4, "f"),
            ("", "d/", 5, "n"), ("", ".", 6, "n"), ("", "n" * 250, 7, "long"), ("", "m" * 300, 8, "n"),
            ("", "none", 9, None), (None, "null", 10, "kept"), ("", None, 11, "n")]
    df = spark.createDataFrame(rows, "bundle string, path string, seq long, content string")
    out = tmp_path / "one two"
    found = extract_status(df, f"file://{tmp_path}/one%20two").collect()
    assert sorted((r.path or "", r.status) for r in found) == sorted([
        ("a", "WRITTEN"), ("x/y", "WRITTEN"), ("x", "CONFLICT"), ("d/", "UNSAFE"), (".", "UNSAFE"),
        ("n" * 250, "WRITTEN"), ("m" * 300, "FAILED"), ("none", "FAILED"), ("null", "WRITTEN"), ("", "UNSAFE"),
    ])
    texts = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    assert texts == {"%2E%2E/a": "in", "x/y": "new", "n" * 250: "long", "null": "kept"}
    for bad in ("nosuch://host/out", "viewfs://x/out"):
        with pytest.raises(ValueError):
            extract_files(df, bad)


def test_walk_of_uris_and_of_names_that_are_not_utf8(spark, tmp_path):
    root = build(tmp_path / "t u", {"a": "1"})
    folder = os.fsencode(root) + b"/d\xff"
    os.mkdir(folder)
    with open(folder + b"/\xfe.c", "wb") as sink:
        sink.write(b"odd")
    rows = read_content(catalog_walk(spark, [f"file://{tmp_path}/t%20u"])).collect()
    assert {(os.path.relpath(r.path, root), bytes(r.content), r.ext) for r in rows} == {
        ("a", b"1", ""), ("d\ufffd/\ufffd.c", b"odd", ".c")
    }
    with pytest.raises(ValueError, match="local"):
        catalog_walk(spark, ["s3a://bucket/x"])


def test_stream_packs_each_batch(spark, tmp_path, make_files):
    source = str(tmp_path / "in")
    rows = [("b", f"p{i}", f"text {i}".encode()) for i in range(6)]
    files = make_files(rows)
    files.filter("seq < 3").coalesce(1).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(files.schema).parquet(source)
        query = pack_stream(stream, PackConfig(name_pattern="p[!4]"), str(tmp_path / "out"),
                            str(tmp_path / "ck"), availableNow=True)
        query.awaitTermination()
        files.filter("seq >= 3").coalesce(1).write.mode("append").parquet(source)
    batches = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert batches == ["batch=0", "batch=1"]
    texts = []
    for name in batches:
        parts = sorted((tmp_path / "out" / name).rglob("part-*"), key=str)
        texts.append("".join(p.read_text() for p in parts))
    assert texts[0] == model.pack([(p, d) for _, p, d in rows[:3]])
    assert texts[1] == model.pack([(p, d) for _, p, d in rows[3:] if p != "p4"])
    with pytest.raises(ValueError):
        pack_stream(stream, PackConfig(file_cap=1), "x", "y")


def test_same_path_in_two_bundles(spark, make_files, tmp_path):
    rows = [("A", "x.txt", b"from a\n"), ("B", "x.txt", b"from b\n"), ("B", "y.txt", b"y\n")]
    pack_files(make_files(rows), PackConfig(), str(tmp_path / "out"))
    bundles = str(tmp_path / "out" / "bundles")
    with pytest.raises(ValueError, match="x.txt"):
        unpack_bundles(spark, bundles, str(tmp_path / "flat"))
    assert unpack_bundles(spark, bundles, str(tmp_path / "apart"), flat=False) == 3
    assert (tmp_path / "apart" / "A" / "x.txt").read_text() == "from a\n"
    assert (tmp_path / "apart" / "B" / "x.txt").read_text() == "from b\n"
