import random

import pytest
from pyspark.sql import functions as F

from bindery.config import PackConfig
from bindery.functions.globs import GlobError
from bindery.operators import admission, catalog, packing, report
from bindery.operators.prefix import running_total


def test_running_total_equals_plain_sum(spark):
    """Uneven groups, gaps in the order, negative orders and a tiny block."""
    rng = random.Random(5)
    rows = []
    for group, n in (("hot", 4000), ("a", 1), ("b", 37), ("", 300)):
        orders = rng.sample(range(-5000, 90_000), n)
        rows += [(group, o, rng.randint(0, 9)) for o in orders]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(6)
    got = {
        (r.g, r.o): (r.total, r.total_before)
        for r in running_total(df, ["g"], "o", F.col("v"), "total").collect()
    }
    expected, sums = {}, {}
    for g, o, v in sorted(rows):
        before = sums.get(g, 0)
        sums[g] = before + v
        expected[(g, o)] = (sums[g], before)
    assert got == expected


def test_admission_reasons_in_order(spark):
    cfg = PackConfig(
        skip_patterns=("*.log", "*/tmp/*"), max_bytes=10, name_pattern="n*", types="c, .h"
    )
    rows = [
        ("a/.n.log", 99, "DOT"), ("a/n.log", 99, "SKIP"), ("a/tmp/n.c", 1, "SKIP"),
        ("a/x.c", 11, "SIZE"), ("a/n.c", None, "SIZE"), ("a/x.c", 10, "NAME"),
        ("a/n.md", 10, "TYPE"), ("a/n", 1, "TYPE"), ("a/n.c", 10, "OK"), (".h/n.h", 0, "OK"),
    ]
    files = catalog.with_path_parts(spark.createDataFrame(
        [(i, "b", p, s) for i, (p, s, _) in enumerate(rows)],
        "seq long, bundle string, path string, size long",
    ))
    got = admission.with_reason(files, cfg).orderBy("seq").collect()
    assert [r.reason for r in got] == [e for _, _, e in rows]
    assert admission.admit(files, cfg).count() == 2
    counts = {r.reason: (r.files, r.bytes) for r in admission.admission_counts(
        admission.with_reason(files, cfg)).collect()}
    assert counts["SKIP"] == (2, 100) and counts["SIZE"] == (2, 11) and counts["OK"] == (2, 10)


def test_hidden_on_and_all_types(spark):
    files = catalog.with_path_parts(spark.createDataFrame(
        [(0, "b", ".x", 1)], "seq long, bundle string, path string, size long"))
    assert admission.admit(files, PackConfig()).count() == 0
    shown = PackConfig(include_hidden=True, types=".c", all_types=True)
    assert admission.admit(files, shown).count() == 1
    assert admission.admit(files, PackConfig(include_hidden=True, types=".c")).count() == 0


def test_zero_size_limit_keeps_empty_files(spark):
    files = catalog.with_path_parts(spark.createDataFrame(
        [(0, "b", "x", 0), (1, "b", "y", 1)], "seq long, bundle string, path string, size long"))
    assert [r.path for r in admission.admit(files, PackConfig(max_bytes=0)).collect()] == ["x"]


def test_bad_settings_raise_before_any_job():
    with pytest.raises(GlobError):
        PackConfig(name_pattern="a[")
    with pytest.raises(GlobError):
        PackConfig(skip_patterns=("x", "a**"))
    with pytest.raises(ValueError):
        PackConfig(max_bytes=-1)


def test_file_cap(spark):
    files = spark.range(20_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
            F.concat(F.lit("b"), F.col("id") % 7)).alias("bundle"),
    )
    for n in (0, 1, 500, 5000):
        got = admission.file_cap(files, n, span=64).groupBy("bundle").agg(
            F.count("*").alias("n"), F.max("seq").alias("top")).collect()
        plain = {}
        for row in files.orderBy("seq").collect():
            plain.setdefault(row.bundle, []).append(row.seq)
        expected = {b: (min(n, len(s)), s[min(n, len(s)) - 1]) for b, s in plain.items() if n}
        assert {r.bundle: (r.n, r.top) for r in got} == expected
    assert admission.file_cap(files, 700, per_bundle=False).count() == 700
    assert admission.file_cap(files, 99_999, per_bundle=False).count() == 20_000


def test_cap_is_counted_after_filtering(spark):
    rows = [(0, "b", ".x", 1), (1, "b", "x", 1), (2, "b", "y", 1), (3, "b", "z", 1)]
    files = catalog.with_path_parts(
        spark.createDataFrame(rows, "seq long, bundle string, path string, size long"))
    got = admission.with_reason(files, PackConfig(file_cap=2)).orderBy("seq").collect()
    assert [r.reason for r in got] == ["DOT", "OK", "OK", "CAP"]
    none = admission.with_reason(files, PackConfig(file_cap=0)).orderBy("seq").collect()
    assert [r.reason for r in none] == ["DOT", "CAP", "CAP", "CAP"]


def test_skip_by_table_both_ways(spark):
    rng = random.Random(2)
    paths = [f"d{rng.randint(0, 9)}/f{i}.{rng.choice(['c', 'md', 'é', 'log'])}" for i in range(400)]
    files = catalog.with_path_parts(spark.createDataFrame(
        [(i, "b", p) for i, p in enumerate(paths)], "seq long, bundle string, path string"))
    patterns = ["f1?.c", "*.é", "d3/*", "[x-z]*", "f200.*", "*9?.log", "**/f7.c", "?7.md", "?"]
    table = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    direct = files.filter(
        ~admission.matches_skip(F.col("base_name"), F.col("path"), patterns))
    expected = sorted(r.path for r in direct.collect())
    assert 0 < len(expected) < len(paths)
    for limit in (100, 3):
        kept = admission.skip_by_table(files, table, inline_limit=limit)
        assert sorted(r.path for r in kept.collect()) == expected
    nothing = admission.skip_by_table(files, table.filter("pattern is null"))
    assert nothing.count() == len(paths)


def test_manifest_join_keeps_repeats(spark):
    files = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "seq long, path string")
    tracked = spark.createDataFrame([("a",), ("a",), ("c",), ("gone",)], "path string")
    joined = catalog.manifest_join(files, tracked)
    assert sorted(r.path for r in joined.collect()) == ["a", "a", "c"]
    assert joined.columns == ["seq", "path"]
    unmatched = catalog.unmatched_manifest(files, tracked).collect()
    assert [tuple(r) for r in unmatched] == [("gone", 1)]


def test_manifest_join_splits_a_hot_name(spark):
    """A name that is most of the list is copied in parts, and all of it."""
    files = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "seq long, path string")
    tracked = spark.range(5000).select(
        F.expr("if(id < 3001, 'p0', concat('p', id % 60))").alias("path"))
    counts = {r.path: r.n for r in catalog.manifest_join(files, tracked, chunk=100)
              .groupBy("path").agg(F.count("*").alias("n")).collect()}
    expected = {}
    for i in range(5000):
        name = "p0" if i < 3001 else f"p{i % 60}"
        if int(name[1:]) < 50:
            expected[name] = expected.get(name, 0) + 1
    assert counts == expected
    parts = catalog.manifest_join(files, tracked, chunk=100).rdd.mapPartitions(
        lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(parts) < 3001


def test_union_is_a_bag(spark):
    one = spark.createDataFrame([("a",)], "path string")
    rows = catalog.union_inputs(one, one).orderBy("arg").collect()
    assert [(r.arg, r.path) for r in rows] == [(0, "a"), (1, "a")]


def test_assign_seq_follows_order(spark):
    df = spark.range(3000).select(
        (F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 2).cast("int").alias("arg"))
    ordered = catalog.assign_seq(df, "arg", "k")
    rows = [(r.arg, r.k) for r in ordered.orderBy("seq").collect()]
    assert rows == sorted(rows)
    assert ordered.select("seq").distinct().count() == 3000


def test_run_summary_states_exclude_each_other(spark):
    rows = [("b", "OK", True, 5, False), ("b", "OK", False, 7, False), ("b", "DOT", False, 9, False),
            ("b", "OK", None, 3, True), ("c", "SKIP", False, 1, False)]
    df = spark.createDataFrame(
        rows, "bundle string, reason string, is_binary boolean, size long, failed boolean")
    got = {r.bundle: tuple(r)[1:] for r in report.run_summary(df).collect()}
    assert got == {"b": (2, 1, 1, 1, 12), "c": (0, 0, 1, 0, 0)}


def test_observed_counters(make_files):
    rendered, watch = report.observed(
        packing.render(make_files([("b", "a", b"x"), ("b", "z", b"\0")])))
    rendered.write.format("noop").mode("overwrite").save()
    assert watch.get["files"] == 2 and watch.get["binary"] == 1 and watch.get["bytes"] > 40


@pytest.mark.parametrize("limit", [0, 100])
def test_pattern_table_treats_nulls_and_faults_alike(spark, limit):
    files = spark.createDataFrame(
        [(1, "b", "a/x.log", "x.log"), (2, "b", None, None), (3, "b", "a/y.txt", "y.txt")],
        "seq long, bundle string, path string, base_name string",
    )
    globs = spark.createDataFrame([("*.log",), ("??",)], "glob string")
    kept = admission.skip_by_table(files, globs, inline_limit=limit)
    assert sorted(r.seq for r in kept.collect()) == [2, 3]
    bad = spark.createDataFrame([("a**b",)], "glob string")
    with pytest.raises(ValueError, match="whole path component"):
        admission.skip_by_table(files, bad, inline_limit=limit)


def test_null_path_has_a_reason(spark):
    files = spark.createDataFrame(
        [(1, "b", None, None, None, 3), (2, "b", "x", "x", "", 2**40)],
        "seq long, bundle string, path string, base_name string, ext string, size long",
    )
    cfg = PackConfig(include_hidden=True)
    reasons = {r.seq: r.reason for r in admission.with_reason(files, cfg).collect()}
    assert reasons == {1: "UNREADABLE", 2: "OK"}
    assert [r.seq for r in admission.admit(files, cfg).collect()] == [2]
