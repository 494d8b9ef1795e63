"""Frames as bundle text files and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import text
from bindery.operators import report
from bindery.sizing import task_count

SHARD_DIGITS = 12


def write_bundles(
    sharded: DataFrame, out: str, mode: str = "errorifexists"
) -> dict[str, int]:
    """Write `bundle, shard, seq, frame` rows as `bundle=…/shard=…/` text files.

    One shuffle, on (bundle, shard): a shard's bytes are bounded, so no task
    gets a whole large bundle, and each shard is one file however many tasks.
    The files of a bundle, joined in name order, are its packed text. Returns
    the counts of files, binary files (where `is_binary` is given) and bytes.
    """
    shard = F.lpad(F.col("shard").cast("string"), SHARD_DIGITS, "0")
    extra = [c for c in sharded.columns if c == "is_binary"]
    rows = sharded.select(
        "bundle",
        shard.alias("shard"),
        "seq",
        text.without_final_lf(F.col("frame")).alias("value"),  # the writer adds it again
        *extra,
    )
    placed = rows.repartition(task_count(sharded.sparkSession), "bundle", "shard")
    counted, watch = report.observed(placed, F.octet_length("value") + 1)
    # The order must come last: the writer sorts again if it cannot see it.
    ordered = counted.sortWithinPartitions("bundle", "shard", "seq").drop("seq", *extra)
    ordered.write.mode(mode).partitionBy("bundle", "shard").text(out)
    return report.counters(watch)


def write_planned(
    placed: DataFrame, tasks: int, out: str, mode: str = "errorifexists"
) -> dict[str, int]:
    """Write `bundle, shard, task, seq, frame` rows as `bundle=…/part-…` text files.

    One shuffle, straight to the planned task, of `tasks`. A task writes one file for
    each bundle it holds, of as many shards as are there, so files are no more than
    tasks and bundles together, however small the shards. A bundle's files, joined in the
    order of their part numbers, are its packed text. Returns counts as `write_bundles`.
    """
    extra = [c for c in placed.columns if c == "is_binary"]
    rows = placed.select(
        "bundle",
        "shard",
        "task",
        "seq",
        text.without_final_lf(F.col("frame")).alias("value"),  # the writer adds it again
        *extra,
    )
    dealt = rows.repartitionById(tasks, "task").drop("task")
    counted, watch = report.observed(dealt, F.octet_length("value") + 1)
    ordered = counted.sortWithinPartitions("bundle", "shard", "seq").drop("shard", "seq", *extra)
    ordered.write.mode(mode).partitionBy("bundle").text(out)
    return report.counters(watch)


def write_table(rows: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Parquet form of frames or manifests; needs no markers in the text."""
    rows.write.mode(mode).parquet(out)


write_manifest = write_table
