"""Order, union and manifest joins of file catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import paths
from bindery.scratch import materialize
from bindery.sizing import task_count


# Copies of one listed name that one task may make.
COPY_CHUNK = 1_000_000


def with_path_parts(files: DataFrame) -> DataFrame:
    """Add `base_name` and `ext` derived from `path`."""
    return files.withColumn("base_name", paths.base_name(F.col("path"))).withColumn(
        "ext", paths.extension(F.col("base_name"))
    )


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """All inputs one after another, with the argument index in `arg`.

    A bag: a file that two inputs name is there twice.
    """
    tagged = [df.withColumn("arg", F.lit(i)) for i, df in enumerate(inputs)]
    return reduce(DataFrame.unionByName, tagged)


def assign_seq(files: DataFrame, *order: str) -> DataFrame:
    """Add `seq`, rising with the given order columns over all rows.

    Range partitions are sorted in parallel and numbered in partition order;
    the result is written once, since numbering again could cut elsewhere. The
    row's own number breaks ties, so that copies of one path can be cut apart.
    """
    tied = files.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    numbered = ranged.withColumn("seq", F.monotonically_increasing_id())
    return materialize(numbered.drop("_tie"), "seq")


def _copy_counts(tracked: DataFrame, key: str) -> DataFrame:
    return tracked.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


def manifest_join(
    files: DataFrame, tracked: DataFrame, key: str = "path", chunk: int = COPY_CHUNK
) -> DataFrame:
    """Files named in a tracked list, once for each time the list names them.

    The list is counted by key first, so that repeats neither travel nor meet
    in the join; the copies are made after it. A key with more than `chunk`
    copies is dealt out in parts, so that no one task makes them all. There are
    at most list rows / chunk such keys, which bounds the broadcast; where there
    are none, adaptive execution drops that branch without reading the files.
    """
    counted = _copy_counts(tracked, key)
    common = files.join(counted.filter(F.col("copies") <= chunk), key)
    last_part = F.expr(f"(copies - 1) div {int(chunk)}")
    hot = (
        files.join(F.broadcast(counted.filter(F.col("copies") > chunk)), key)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last_part)))
        .repartition(task_count(files.sparkSession), key, "_part")
        .withColumn("copies", F.least(F.col("copies") - F.col("_part") * chunk, F.lit(chunk)))
        .drop("_part")
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return common.unionByName(hot).withColumn("_copy", copies).select(*files.columns)


def unmatched_manifest(files: DataFrame, tracked: DataFrame, key: str = "path") -> DataFrame:
    """Tracked names that no file has, and how often each is on the list."""
    return _copy_counts(tracked, key).join(files.select(key), key, "left_anti")
