"""Extraction in two steps: files are staged, and appear only when all is decided.

`stage` writes every row's content under a hidden folder beside the target, through a
data source of its own: a task attempt has its own folder and ends with a list of what it
wrote; `commit` on the driver notes the attempts that count, one name for each task, and
`abort` takes the whole staging folder away. What lost or doubled attempts left is never
listed. Checks then run on the lists, which hold keys and digests but no content, so the
rows are computed once.

`decide` writes which staged file gets which path; from then on the extraction can be
finished by anyone (`finish_extractions`). `publish` renames, and a repeated rename finds
its work done. Before the decision nothing is visible; `discard` forgets it.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from bindery import stores
from bindery.functions import paths
from bindery.scratch import materialize
from bindery.sinks.files import CONFLICT, UNSAFE, folder_clashes, split_safe

# Goes to the tasks with their code, so that it works where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Begins the names of staging folders; `.` keeps them out of walks and of Spark's reading.
STAGING = ".staging-"
#: Files in one folder of an attempt.
FOLDER_FILES = 1_000


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: the name of its attempt."""

    attempt: str


class StagingWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Each row's `content` as a file, and `place` with the other columns in a list."""
        attempt, n = uuid.uuid4().hex, 0
        store, base = stores.open_store(self.folder)
        lists = f"{base}/lists"
        store.create_dir(lists, recursive=True)
        listing = None
        for batch in batches:
            places = []
            for content in batch.column("content"):
                if not content.is_valid:
                    places.append(None)
                    continue
                folder = f"{attempt}/{n // FOLDER_FILES}"
                if n % FOLDER_FILES == 0:
                    store.create_dir(f"{base}/{folder}", recursive=True)
                with store.open_output_stream(f"{base}/{folder}/{n}") as sink:
                    sink.write(content.as_buffer())
                places.append(f"{folder}/{n}")
                n += 1
            rows = pa.table(batch.drop_columns(["content"]))
            rows = rows.append_column("place", pa.array(places, pa.string()))
            rows = rows.append_column("attempt", pa.array([attempt] * len(places), pa.string()))
            if listing is None:
                sink = store.open_output_stream(f"{lists}/{attempt}.parquet")
                listing = pq.ParquetWriter(sink, rows.schema)
            listing.write_table(rows)
        if listing is not None:
            listing.close()
            sink.close()
        return Staged(attempt if listing is not None else "")

    def commit(self, messages: list[Staged | None]) -> None:
        attempts = [m.attempt for m in messages if m is not None and m.attempt]
        store, base = stores.open_store(self.folder)
        store.create_dir(f"{base}/attempts", recursive=True)
        with store.open_output_stream(f"{base}/attempts/attempts.parquet") as sink:
            pq.write_table(pa.table({"attempt": pa.array(attempts, pa.string())}), sink)

    def abort(self, messages: list[Staged | None]) -> None:
        _remove(self.folder)


class StagingSource(DataSource):
    """Option `folder`: the staging folder, a path or URI all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "bindery_staging"

    def writer(self, schema, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["folder"])


def _remove(folder: str, tries: int = 20) -> None:
    """Delete a folder; again if a task that is being stopped still writes to it."""
    store, base = stores.open_store(folder)
    for left in reversed(range(tries)):
        if store.get_file_info(base).type != fs.FileType.Directory:
            return
        try:
            store.delete_dir(base)
        except OSError:
            if not left:
                raise
            time.sleep(0.5)


def _forget(out: str, folder: str, created: bool) -> None:
    """Delete a staging folder, and the target with it if it was made for it."""
    _remove(folder)
    store, base = stores.open_store(out)
    if created and not store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        _remove(out)


@dataclass(frozen=True)
class Staging:
    """A staging folder and the list of what counts in it."""

    out: str
    folder: str
    listing: DataFrame
    created: bool  # was there no target folder before?

    def discard(self) -> None:
        """Take away all that is staged; the target is as it was."""
        _forget(self.out, self.folder, self.created)


def stage(rows: DataFrame, out: str) -> Staging:
    """Stage `content` of each row under `out`; the list has the other columns and `place`.

    One job, which computes `rows` once. `place` is null where there is no content. A job
    that fails leaves nothing. `out` is a path that all executors share, or a URI that
    pyarrow and Spark can open; others raise `ValueError`.
    """
    store, base = stores.open_store(out)
    created = store.get_file_info(base).type == fs.FileType.NotFound
    spark = rows.sparkSession
    folder = f"{out.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"
    spark.dataSource.register(StagingSource)
    binary = rows.withColumn("content", F.col("content").cast("binary"))
    try:
        binary.write.format(StagingSource.name()).mode("append").option("folder", folder).save()
    except Exception:
        time.sleep(1)  # tasks of the job that still run are being stopped
        _forget(out, folder, created)
        raise
    schema = binary.drop("content").schema.add("place", "string").add("attempt", "string")
    read = spark.read.schema(schema).option("recursiveFileLookup", True)
    counted = spark.read.schema("attempt string").parquet(f"{folder}/attempts")
    if counted.isEmpty():
        listing = spark.createDataFrame([], schema)
    else:
        listing = read.parquet(f"{folder}/lists").join(counted, "attempt", "left_semi")
    return Staging(out, folder, listing.drop("attempt"), created)


def latest(listing: DataFrame, order: str) -> DataFrame:
    """The last row of each (bundle, path) by `order`; folded before the shuffle."""
    others = [c for c in listing.columns if c not in ("bundle", "path")]
    last = F.max_by(F.struct(*others), order).alias("last")
    return listing.groupBy("bundle", "path").agg(last).select("bundle", "path", "last.*")


def decide(staging: Staging, rows: DataFrame, order: str = "seq", prefix: str = "") -> DataFrame:
    """`bundle, path, place, status` of the staged rows that are to be extracted, written.

    As in `extract_status`: `UNSAFE` paths and files in the way of a folder (`CONFLICT`)
    get no file, and of two spellings of a path the last by `order` counts. The written
    table is the commit: what it names will appear.
    """
    named = rows.withColumn("bundle", F.coalesce("bundle", F.lit("")))
    safe, unsafe = split_safe(named, prefix)
    tidy = safe.withColumn("path", paths.tidy_path(F.col("path")))
    tidy = latest(tidy.select("bundle", "path", order, "place"), order)
    clashes = folder_clashes(tidy).distinct().withColumn("status", F.lit(CONFLICT))
    decided = tidy.join(clashes, ["bundle", "path"], "left").select("bundle", "path", "place", "status")
    lost = unsafe.select("bundle", "path", F.lit(None).cast("string").alias("place"), F.lit(UNSAFE).alias("status"))
    folder = f"{staging.folder}/decided"
    decided.unionByName(lost).write.parquet(folder)
    return rows.sparkSession.read.schema("bundle string, path string, place string, status string").parquet(folder)


def _publisher(out: str, folder: str):
    def publish_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath

        store, base = stores.open_store(out)
        _, staged = stores.open_store(folder)
        made = set()
        for batch in batches:
            status = []
            for row in batch.itertuples():
                target, source = f"{stores.folder_of(base, row.bundle)}/{row.path}", f"{staged}/{row.place}"
                try:
                    if row.place is None:
                        raise ValueError("no content")
                    if store.get_file_info(source).is_file:
                        parent = posixpath.dirname(target)
                        if parent not in made:
                            store.create_dir(parent, recursive=True)
                            made.add(parent)
                        store.move(source, target)
                    elif not store.get_file_info(target).is_file:  # else an earlier attempt moved it
                        raise ValueError("not staged")
                    status.append("WRITTEN")
                except (OSError, ValueError):
                    status.append("FAILED")
            yield batch[["bundle", "path"]].assign(status=status)

    return publish_files


def publish(decided: DataFrame, out: str, folder: str) -> DataFrame:
    """Move what was decided into place; `bundle, path, status` of each path.

    Renames within one file system, in as many tasks as the table has; an object store
    copies. A task may run twice. The staging folder goes at the end.
    """
    known = decided.where("status is not null").select("bundle", "path", "status")
    moved = decided.where("status is null").select("bundle", "path", "place")
    moved = moved.mapInPandas(_publisher(out, folder), "bundle string, path string, status string")
    done = materialize(moved.unionByName(known), "extracted")
    _remove(folder)
    return done


def extract_commit(rows: DataFrame, out: str, order: str = "seq", prefix: str = "") -> DataFrame:
    """`extract_status` with one reading of `rows`, and nothing visible before all is staged."""
    staging = stage(rows.select("bundle", "path", order, "content"), out)
    return publish(decide(staging, staging.listing, order, prefix), out, staging.folder)


def finish_extractions(spark: SparkSession, out: str) -> int:
    """Publish what was decided under `out` and not finished, and drop what was not decided.

    For runs whose driver was lost; returns the number of extractions finished. No
    extraction into `out` may be under way.
    """
    store, base = stores.open_store(out)
    finished = 0
    for entry in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if not entry.base_name.startswith(STAGING):
            continue
        folder = f"{out.rstrip('/')}/{entry.base_name}"
        if store.get_file_info(f"{base}/{entry.base_name}/decided/_SUCCESS").is_file:
            schema = "bundle string, path string, place string, status string"
            publish(spark.read.schema(schema).parquet(f"{folder}/decided"), out, folder)
            finished += 1
        else:
            _remove(folder)
    return finished
