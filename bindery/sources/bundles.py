"""Bundle text files as frame rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import frames
from bindery.operators.unpacking import parse_records


def read_bundles(
    spark: SparkSession, path: str | list[str], foldered: bool = True
) -> DataFrame:
    """`bundle, pos, path, signature, kind, body` from bundle files.

    The frame break is the record separator, so a large file is read by many
    tasks. `bundle` comes from the folders that `write_planned` and `write_bundles` make;
    without them (`foldered=False`) each file is its own bundle. `pos` orders the
    frames of a bundle: by the shard's folder, if there are any, and the file's part
    number, which outgrows its five digits in large runs.
    """
    records = bundle_records(spark, path, foldered)
    return parse_records(records.drop("bytes", "skipped", "file_size"))


def bundle_records(
    spark: SparkSession, path: str | list[str], foldered: bool = True
) -> DataFrame:
    """`bundle, pos, record, bytes, skipped, file_size`: what lies between the frame breaks
    of bundle files, its bytes in the file, and how many of these come before the record."""
    reader = spark.read.option("lineSep", frames.FRAME_BREAK)
    if foldered:
        # Typed here, so that a bundle called 007 keeps its zeros.
        lines = reader.schema("value string, bundle string").text(path)
        folder = F.col("shard") if "shard" in lines.columns else F.lit(0)
        part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).try_cast("long")
        bundle = F.col("bundle")
        shard = F.struct(folder.cast("long").alias("folder"), part.alias("part"))
    else:
        lines = reader.text(path)
        bundle = F.col("_metadata.file_path")
        shard = F.struct(F.lit(0).cast("long").alias("folder"), F.lit(0).cast("long").alias("part"))
    first = (F.col("start") == 0) & F.startswith(F.col("value"), F.lit(frames.HEADER_PREFIX))
    start_cut = F.substr(F.col("value"), F.lit(len(frames.HEADER_PREFIX) + 1))
    return lines.select(
        F.coalesce(bundle, F.lit("")).alias("bundle"),  # folders cannot have empty names
        shard.alias("shard"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
        F.col("_metadata.file_size").alias("file_size"),
        "value",
    ).select(
        "bundle",
        F.struct("shard", "file", "start", "row").alias("pos"),
        F.when(first, start_cut).otherwise(F.col("value")).alias("record"),
        F.octet_length("value").cast("long").alias("bytes"),
        F.when(first, F.lit(len(frames.HEADER_PREFIX))).otherwise(F.lit(0)).alias("skipped"),
        "file_size",
    )
