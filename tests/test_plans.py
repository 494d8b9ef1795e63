"""Physical plans: what is read, what is shuffled, what is broadcast."""

import os
import re

import pytest
from pyspark.sql import functions as F

from bindery.config import PackConfig
from bindery.operators import admission, integrity, packing, unpacking
from bindery.operators.prefix import running_total
from bindery.plans.queries import QUERIES
from bindery.sinks.bundles import write_bundles
from bindery.sources.tables import files_from_table

SF_DIR = "/root/testdata/sf0.001"
if not os.path.isdir(SF_DIR):
    pytest.skip("no test tables", allow_module_level=True)


def final_plan(df):
    """Physical plan after the run, as adaptive execution left it."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def exchanges(plan):
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*), \d+\)", plan)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.fixture
def stored(spark, tmp_path, make_files):
    """Files in a table that stores size and extension."""
    rows = [(f"b{i % 3}", f"d/f{i}.{'c' if i % 2 else 'md'}", b"x" * i) for i in range(200)]
    make_files(rows).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


MAP_ONLY = [
    "admission_reason", "ascii_mask", "binary_flag", "blank_run_audit", "collision_audit",
    "dot_filter", "frame_render", "header_parse", "integrity_manifest", "keyed_digest",
    "name_filter", "path_parts", "preview", "roundtrip_text", "signed_frames", "size_filter",
    "skip_filter", "squeeze_blank", "type_filter", "union_inputs", "utf8_text", "repo_name",
    "safe_path", "type_lists", "path_audit",
]


@pytest.mark.parametrize("name", MAP_ONLY)
def test_map_only_queries_do_not_shuffle(spark, name):
    plan = final_plan(QUERIES[name](spark, SF_DIR))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_no_query_has_a_product_or_python_in_its_hot_path(spark):
    for name in ("pack_bundles", "unpack_frames", "verify_counts", "last_wins", "file_cap",
                 "manifest_join", "run_summary", "shard_plan"):
        plan = final_plan(QUERIES[name](spark, SF_DIR))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Python" not in plan and "Arrow" not in plan, name


def test_path_filters_read_no_text(spark):
    for name in ("dot_filter", "skip_filter", "name_filter", "type_filter", "path_parts"):
        schema = re.findall(r"ReadSchema: (\S+)", final_plan(QUERIES[name](spark, SF_DIR)))
        assert schema and all("text" not in s for s in schema), name


def test_filters_reach_a_stored_table(stored):
    cfg = PackConfig(max_bytes=20, types="c,h", name_pattern="*.c", skip_patterns=("x*", "?y"))
    plan = final_plan(admission.admit(stored, cfg).select("path"))
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", plan).group(1)
    assert "StringEndsWith(base_name,.c)" in pushed and "In(ext" in pushed
    assert "LessThanOrEqual(size,20)" in pushed and "Not(StringStartsWith" in pushed
    assert "content" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_shard_plan_reads_no_content(stored, no_broadcast):
    plan = final_plan(packing.shard_plan(stored, 1000))
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert schemas and all("content" not in s and "path" not in s for s in schemas)


def test_running_totals_sum_ranges_not_rows(spark, no_broadcast):
    """However sparse the order values, a group's window sees one row per partition."""
    rows = spark.range(5000).selectExpr("'g' as bundle", "id * 1000003 as seq", "1L as n")
    total = running_total(rows, ["bundle"], "seq", F.col("n"), "total")
    assert total.where("total != seq div 1000003 + 1").isEmpty() and total.count() == 5000
    scan = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", final_plan(total))
    assert len(scan) == 2
    assert [("_part" in keys, "_part" in order) for keys, order in sorted(scan, key=len)].count(
        (False, True)) == 1


def test_pack_moves_content_once(stored, spark):
    """With the shard cuts broadcast, content goes only to its shard."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "20000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(packing.pack(stored, 1000))
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = re.findall(r"ReadSchema: (\S+)", plan)
    assert sum("content" in s for s in scans) == 1
    content = [k for k in exchanges(plan) if "shard#" in k and k.count("#") == 2]
    assert len(content) == 1 and "bundle#" in content[0]
    assert "BroadcastHashJoin" in plan


def test_without_broadcast_no_exchange_is_by_bundle_alone(stored, no_broadcast):
    """A bundle with a third of all rows must not be one task; only the block
    totals, one row per some thousand files, are put together by bundle."""
    plan = final_plan(packing.pack(stored, 1000))
    by_bundle = [k for k in exchanges(plan) if k.count("#") == 1]
    assert len(by_bundle) == 1
    assert any("shard#" in k for k in exchanges(plan))


def test_verify_shuffles_digests_only(stored, no_broadcast):
    unpacked = stored.withColumn("kind", F.lit("text")).withColumn(
        "body", F.col("content").cast("string"))
    status = integrity.verify(
        integrity.frame_digests(unpacked), integrity.integrity_manifest(stored))
    plan = final_plan(status)
    keys = exchanges(plan)
    assert len(keys) == 2 and all("path#" in k for k in keys)  # the join adds none
    below = plan.split("Exchange")[1:]
    assert all("partial_max_by(sha256" in part for part in below)


def test_last_wins_leaves_content_where_it_is(stored):
    twice = stored.unionByName(stored.withColumn("seq", F.col("seq") + 1000))
    last = unpacking.last_wins(twice.select("bundle", "path", "seq", "content"))
    assert last.count() == 200 and last.where("seq < 1000").isEmpty()
    plan = final_plan(last)
    assert "BroadcastHashJoin" in plan and not exchanges(plan)


def test_written_shards_are_one_file_each(stored, tmp_path):
    out = tmp_path / "out"
    write_bundles(packing.assign_shards(packing.render(stored), stored, 1000), str(out))
    folders = [p for p in out.glob("bundle=*/shard=*")]
    assert len(folders) > 5
    assert all(len(list(f.glob("part-*"))) == 1 for f in folders)
