"""Counts of a run, per bundle and live."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from bindery.operators.admission import OK


def run_summary(files: DataFrame) -> DataFrame:
    """Per bundle: files in exactly one of processed, failed and skipped, with
    the binary ones and the bytes among the processed.

    Expects `reason`, `is_binary`, `size` and, where reading can fail, `failed`.
    """
    admitted = F.col("reason") == OK
    failed = admitted & (F.col("failed") if "failed" in files.columns else F.lit(False))
    processed = admitted & ~failed
    return files.groupBy("bundle").agg(
        F.count_if(processed).alias("processed"),
        F.count_if(failed).alias("failed"),
        F.count_if(~admitted).alias("skipped"),
        F.count_if(processed & F.col("is_binary")).alias("binary"),
        F.coalesce(F.sum(F.when(processed, F.col("size"))), F.lit(0)).alias("bytes"),
    )


def observed(rows: DataFrame, n_bytes: Column | None = None) -> tuple[DataFrame, Observation]:
    """Attach live counters (files, binary, bytes) that fill as the rows pass,
    at no cost of a second job.

    Attach them after the last shuffle before an action: a stage before it may
    run tasks again after a loss, and would count them twice.
    """
    watch = Observation()
    size = F.octet_length("frame") if n_bytes is None else n_bytes
    binary = F.col("is_binary") if "is_binary" in rows.columns else F.lit(False)
    metrics: list[Column] = [
        F.count(F.lit(1)).alias("files"),
        F.count_if(binary).alias("binary"),
        F.sum(size.cast("long")).alias("bytes"),
    ]
    return rows.observe(watch, *metrics), watch


def counters(watch: Observation) -> dict[str, int]:
    """Values of `observed` after its action; zeros when there were no rows.

    Spark drops the counters of a plan it finds to be empty while running, and
    then has no row to give.
    """
    try:
        values = watch.get
    except Py4JJavaError:
        values = {}
    return {name: values.get(name) or 0 for name in ("files", "binary", "bytes")}
