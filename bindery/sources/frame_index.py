"""Where each frame lies in its bundle file, and reads of the named ones alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery import stores
from bindery.functions import frames
from bindery.operators.unpacking import parse_records
from bindery.scratch import materialize
from bindery.sizing import TASK_BYTES, task_count
from bindery.sources.bundles import bundle_records

# Bytes of a frame break, and of the mark of UTF-8 that readers pass over.
_BREAK, _MARK = len(frames.FRAME_BREAK), 3
_BATCH_BYTES = 32 * 1024 * 1024


def index_frames(
    spark: SparkSession, path: str | list[str], foldered: bool = True
) -> DataFrame:
    """`bundle, pos, path, signature, kind, file, offset, length` of every frame.

    `offset` and `length` are bytes of the record, header included, after the mark that
    opens it. Takes what `read_bundles` takes; files are read once, and what is kept of them
    has no text. Lengths are summed within the splits that Spark read, and the splits' totals
    within a file, so that a file of any size has no window of all its frames.
    Write the index beside the bundle (`sinks.bundles.write_table`) to look frames up later.
    """
    parsed = parse_records(bundle_records(spark, path, foldered)).drop("body")
    rows = materialize(
        parsed.withColumn("file", F.col("pos.file")).withColumn("start", F.col("pos.start")),
        "records",
    )
    taken = F.col("bytes") + _BREAK
    splits = rows.groupBy("file", "start").agg(
        F.sum(taken).alias("_bytes"), F.max("file_size").alias("_size")
    )
    whole = Window.partitionBy("file")
    # A file's breaks are one fewer than its records, but for one that ends in a break.
    over = F.col("_size") - (F.sum("_bytes").over(whole) - _BREAK)
    mark = F.when(over.isin(_MARK, _MARK + _BREAK), F.lit(_MARK)).otherwise(F.lit(0))
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select(
        "file", "start", (mark + F.coalesce(F.sum("_bytes").over(before), F.lit(0))).alias("_base")
    )
    inside = Window.partitionBy("file", "start").orderBy("pos.row")
    earlier = F.sum(taken).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
        .join(bases, ["file", "start"])
        .select(
            "bundle", "pos", "path", "signature", "kind", "file",
            (F.col("_base") + F.col("_earlier") + F.col("skipped")).alias("offset"),
            (F.col("bytes") - F.col("skipped")).alias("length"),
        )
    )


def read_frames(index: DataFrame) -> DataFrame:
    """`bundle, pos, path, signature, kind, body` of the frames in these rows of an index.

    Filter or join the index first: tasks open the files and read the stretches asked for,
    nothing else. Rows are dealt by ranges of file and offset, so that a task goes forward
    through few files. A file that is gone or shorter than the index says ends the job.
    """
    held = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(task_count(index.sparkSession), -(-held // TASK_BYTES))
    asked = (
        index.select("bundle", "pos", "file", "offset", "length")
        .repartitionByRange(tasks, "file", "offset")
        .sortWithinPartitions("file", "offset")
        .select(F.struct("bundle", "pos").alias("who"), "file", "offset", "length")
        .select(F.to_json("who").alias("who"), "file", "offset", "length")
    )
    limit = _BATCH_BYTES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, source = None, None
        try:
            for batch in batches:
                who, records, size = [], [], 0
                for row in batch.itertuples(index=False):
                    if row.file != name:
                        if source is not None:
                            source.close()
                        store, place = stores.open_store(row.file)
                        name, source = row.file, store.open_input_file(place)
                    record = source.read_at(row.length, row.offset)
                    if len(record) != row.length:
                        raise ValueError(f"{row.file} is shorter than its index says")
                    who.append(row.who)
                    records.append(record)
                    size += row.length
                    if size >= limit:
                        yield pd.DataFrame({"who": who, "record": records})
                        who, records, size = [], [], 0
                if who:
                    yield pd.DataFrame({"who": who, "record": records})
        finally:
            if source is not None:
                source.close()

    told = index.select(F.struct("bundle", "pos").alias("who")).schema["who"].dataType
    return parse_records(
        asked.mapInPandas(read, "who string, record binary")
        .withColumn("who", F.from_json("who", told))
        .select("who.bundle", "who.pos", F.col("record").cast("string").alias("record"))
    )
