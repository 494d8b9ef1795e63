"""How many tasks a step gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_BYTES = 128 * 1024 * 1024


def task_count(spark: SparkSession) -> int:
    """The session's shuffle width.

    Given as a number to `repartition`, it is kept as it is; left out, adaptive
    execution would merge rows that are few bytes but much work, such as the
    names of directories to list.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for_bytes(catalog: DataFrame) -> int:
    """Enough tasks for the bytes the files of a catalog hold."""
    held = catalog.agg(F.sum("size")).first()[0] or 0
    return max(task_count(catalog.sparkSession), -(-held // TASK_BYTES))
