"""Long pattern tables against matching every glob on every path."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bindery.functions import globs
from bindery.operators import admission, catalog, patterns


def brute(paths, table):
    tests = [re.compile(rf"(?s)\A(?:{globs.glob_body(p)})\Z") for p in table]
    hit = lambda text: any(t.match(text) for t in tests)
    return sorted(p for p in paths if not (hit(p) or hit(p.rsplit("/", 1)[-1])))


@pytest.fixture(scope="module")
def paths():
    rng = random.Random(5)
    folders = ("home/build", "home/é𝒳/src", "a", "home/build/deep/tree", "")
    made = {f"{rng.choice(folders)}/{rng.choice('fgh')}{i}.{rng.choice(['c', 'md', 'o', 'log'])}"
            for i in range(600)}
    return sorted(made | {"x", "xy", "tail\n"})


@pytest.fixture(scope="module")
def files(spark, paths):
    rows = spark.createDataFrame(
        [(i, f"b{i % 3}", p) for i, p in enumerate(paths)] + [(-1, "b0", None)],
        "seq long, bundle string, path string")
    return catalog.with_path_parts(rows)


# Many share the prefix of every path, some have no literal text, some match nothing.
SHARED = [f"*home/build/*{i}.c" for i in range(40, 60)] + [f"home/build/?{i}.*" for i in range(9)]
TABLES = {
    "shared": SHARED,
    "keyless": ["?", "??", "[x-z]*[0-9]", "?????[!a-z]"],
    "both": [*SHARED, "?", "*é𝒳*", "**/g7.md", "home/**/tree/*.o", "*.log", "no such text*", "**/h9*"],
    "nothing": ["no such text*", "zzz?"],
    "all": [*SHARED, "*", "**"],
}


@pytest.mark.parametrize("name", TABLES)
def test_index_equals_every_glob_on_every_path(spark, files, paths, name):
    table = spark.createDataFrame([(p,) for p in [*TABLES[name], None]], "glob string")
    kept = admission.skip_by_table(files, table, inline_limit=1).collect()
    assert sorted(r.path for r in kept if r.path) == brute(paths, TABLES[name])
    assert sum(r.path is None for r in kept) == 1  # a file without path matches nothing


def test_hot_fragments_are_spread_and_lose_nothing(spark, files, paths):
    table = spark.createDataFrame([("*f*",), ("*home/build/g*",), ("*h9?.c",)], "pattern string")
    index = patterns.compile_index(table)
    skipped = {r.seq for r in patterns.matched_keys(files, index, hot_paths=10).collect()}
    kept = sorted(p for i, p in enumerate(paths) if i not in skipped)
    assert kept == brute(paths, [r.pattern for r in table.collect()])


def test_a_glob_is_keyed_by_its_rarest_fragment(spark, files):
    table = spark.createDataFrame([(p,) for p in SHARED], "pattern string")
    chosen = patterns.rarest_keys(files, patterns.compile_index(table)).collect()
    assert 0 < len(chosen) <= len(SHARED)
    most = files.filter(F.contains("path", F.lit("home/build/"))).count()
    rare = [r for r in chosen if r.body.startswith(".*")]
    assert most > 100 and rare and all(r.paths == most for r in rare)  # 12 letters: one window
    longer = spark.createDataFrame([("*home/build/deep/tree/f1.c",), ("home/build/deep/tree/*",)], "pattern string")
    by_body = {r.body: r.paths for r in patterns.rarest_keys(files, patterns.compile_index(longer)).collect()}
    tree = files.filter(F.contains("path", F.lit("home/build/deep/tree/"))).count()
    assert max(by_body.values()) <= tree < most


def test_no_path_crosses_the_exploded_exchange(spark, files):
    table = spark.createDataFrame([(p,) for p in SHARED], "pattern string")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        stored = files.repartition(2)
        plan = patterns.matched_keys(stored, patterns.compile_index(table))
        text = plan._jdf.queryExecution().sparkPlan().toString()
    finally:
        for key in keys:
            spark.conf.unset(key)
    exploded = [line for line in text.splitlines() if "Generate explode" in line]
    assert exploded and all("path#" not in re.sub(r"explode\(.*?\), \[", "[", line) for line in exploded)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_globs_of_one_common_folder_are_keyed_by_their_short_texts(spark):
    """Each was tried on every path of the folder, whatever its number."""
    paths = [f"a/.cache/doc_{i}.md" for i in range(400)]
    rows = spark.createDataFrame([(i, "b", p) for i, p in enumerate(paths)], "seq long, bundle string, path string")
    table = [f"*/.cache/*{i}[!a]md" for i in range(100, 300)] + ["*/.cache/*no[!a]md", "*/.cache/*7"]
    globbed = spark.createDataFrame([(p,) for p in table], "pattern string")
    files, index = catalog.with_path_parts(rows), patterns.compile_index(globbed)
    chosen = patterns.rarer_keys(files, index).collect()
    assert len(chosen) == 201  # no path holds `no`
    assert sum(r.paths for r in chosen) < 400  # tries; 400 a glob before
    kept = admission.skip_by_table(files, globbed, inline_limit=1).collect()
    assert sorted(r.path for r in kept) == brute(paths, table)
