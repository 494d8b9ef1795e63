"""Rows find their shard or cap by the starts alone, whatever the gaps between order values."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from bindery.operators import admission, packing
from bindery.operators.prefix import as_of


def test_as_of_equals_bisection(spark):
    rng = random.Random(3)
    for size in (0, 1, 2, 3, 7, 64, 100):
        held = sorted(rng.sample(range(-50, 1000), size))
        values = [-60, 0, 999, 2**40, None, *held[:5], *(rng.randint(-60, 1000) for _ in range(20))]
        rows = spark.createDataFrame(list(enumerate(values)), "i int, x bigint")
        rows = rows.withColumn("h", F.array(*map(F.lit, held)).cast("array<bigint>"))
        got = [r.y for r in rows.select("i", as_of("h", "x").alias("y")).orderBy("i").collect()]
        assert got == [bisect.bisect_right(held, v or 0) - 1 for v in values]


@pytest.fixture
def sparse(spark):
    """One hot bundle and small ones, order values in clusters far apart."""
    n = F.col("id")
    return spark.range(3000).select(
        (n * n * 5003 + n % 7 * 10**9).alias("seq"),
        F.when(n % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("b"), n % 7)).alias("bundle"),
        F.concat(F.lit("p"), n).alias("path"), (n * 37 % 400).alias("size"),
    )


@pytest.mark.parametrize("span, entries", [(1, 1000), (3, 1000), (5, 4), (10_000, 10)])
def test_shards_of_sparse_orders(sparse, span, entries):
    plan = packing.shard_plan(sparse, 5000)
    assigned = packing.assign_shards(sparse, sparse, 5000, span=span, entries=entries)
    assert assigned.columns == ["bundle", "seq", "path", "size", "shard"]
    assert sorted(map(tuple, plan.collect())) == sorted(
        map(tuple, assigned.select("bundle", "seq", "shard").collect()))


def test_the_cuts_have_one_entry_for_each_shard(sparse):
    plan = packing.shard_plan(sparse, 5000)
    pages = packing.shard_pages(plan, 8).collect()
    shards = plan.select("bundle", "shard").distinct().count()
    assert sum(len(r.cuts) for r in pages) == shards < 300
    assert all(len(r.cuts) <= 8 for r in pages)


@pytest.mark.parametrize("span", [5, 300, 10**6])
def test_cap_of_hot_and_small_bundles(sparse, span):
    plain = {}
    for row in sparse.orderBy("seq").collect():
        plain.setdefault(row.bundle, []).append(row.seq)
    for n in (0, 1, 150, 500):
        kept = admission.file_cap(sparse, n, span=span).select("bundle", "seq").collect()
        assert sorted(map(tuple, kept)) == sorted(
            (b, s) for b, seqs in plain.items() for s in seqs[:n])


def test_limits_are_one_row_for_each_bundle_over_the_cap(sparse):
    limits = admission.cap_limits(sparse, 500, ["bundle"]).collect()
    assert [(r.bundle, r.files) for r in limits] == [("hot", 2000)]
