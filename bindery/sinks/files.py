"""Extracted rows as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery import stores
from bindery.functions import paths
from bindery.operators.unpacking import last_wins
from bindery.scratch import materialize

# What became of a path.
WRITTEN, UNSAFE, CONFLICT, FAILED = "WRITTEN", "UNSAFE", "CONFLICT", "FAILED"


def split_safe(rows: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows whose path stays under the output folder, the quarantined rest)."""
    relative = rows.withColumn("path", paths.relative_path(F.col("path"), prefix))
    safe = paths.is_safe_path(F.col("path")) & paths.names_file(F.col("path"))
    return relative.filter(safe), relative.filter(~safe)


def folder_clashes(kept: DataFrame) -> DataFrame:
    """`bundle, path` of the files whose path is a folder of another file. Moves keys only."""
    keys = kept.select("bundle", "path")
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    folders = keys.filter(F.contains("path", F.lit("/"))).select("bundle", F.explode(above).alias("path"))
    return keys.join(folders.distinct(), ["bundle", "path"], "left_semi")


def _writer(out: str):
    """Task body: one file a row, straight from the memory of Arrow's batch, which is given
    back before the next one; no content is copied.
    """

    def write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath
        import uuid

        store, base = stores.open_store(out)
        local = store.type_name == "local"

        def write(folder: str, path: str, content: pa.Buffer) -> None:
            target = f"{folder}/{path}"
            parent = posixpath.dirname(target)
            store.create_dir(parent, recursive=True)
            # An object store shows an object only when it is whole.
            place = f"{parent}/.{uuid.uuid4().hex}.tmp" if local else target
            try:
                with store.open_output_stream(place) as sink:
                    sink.write(content)
                if local:
                    store.move(place, target)
            except OSError:
                if local and store.get_file_info(place).is_file:
                    store.delete_file(place)
                raise

        for batch in batches:
            status, content = [], None
            bundles, names, contents = (batch.column(c) for c in ("bundle", "path", "content"))
            for bundle, name, content in zip(bundles, names, contents):
                try:
                    if not content.is_valid:
                        raise ValueError("no content")
                    folder = stores.folder_of(base, bundle.as_py())
                    write(folder, name.as_py(), content.as_buffer())
                    status.append("WRITTEN")
                except (OSError, ValueError):
                    status.append("FAILED")
            told = [pa.array(c.to_pylist(), pa.string()) for c in (bundles, names)]
            told.append(pa.array(status, pa.string()))
            del batch, bundles, names, contents, content
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(told, names=["bundle", "path", "status"])

    return write_files


def extract_status(rows: DataFrame, out: str, order: str = "seq", prefix: str = "") -> DataFrame:
    """Write `bundle, path, content` rows under `out`; `bundle, path, status` of each path.

    Only safe paths are written, the last of each path by `order`; `d//p` and `d/./p`
    are `d/p`. `UNSAFE` paths would leave the folder or name no file, one row for each
    row given. A file whose path is a folder of another file is a `CONFLICT` and the
    other is written. `FAILED` could not be written, such as one without content; the
    rest goes on. Files are written aside and renamed, so a retried or doubled task
    leaves whole files; object stores show whole objects only. Each bundle that has a
    name gets a folder. `out` is a path that all executors share, or a URI that pyarrow
    can open; others raise `ValueError`.
    """
    stores.open_store(out)
    named = rows.withColumn("bundle", F.coalesce("bundle", F.lit("")))
    safe, unsafe = split_safe(named, prefix)
    tidy = safe.withColumn("path", paths.tidy_path(F.col("path")))
    kept = last_wins(tidy.select("bundle", "path", order, "content"), order)
    clashes = materialize(folder_clashes(tidy), "clashes").distinct()
    content = F.col("content").cast("binary").alias("content")
    written = kept.join(clashes, ["bundle", "path"], "left_anti").select("bundle", "path", content)
    written = written.mapInArrow(_writer(out), "bundle string, path string, status string")
    written = materialize(written, "extracted")  # tasks with effects run once
    return written.unionByName(clashes.withColumn("status", F.lit(CONFLICT))).unionByName(
        unsafe.select("bundle", "path", F.lit(UNSAFE).alias("status"))
    )


def extract_files(
    rows: DataFrame, out: str, order: str = "seq", prefix: str = "", report: str | None = None
) -> int:
    """`extract_status`, written as a table under `report` if given; returns the files written."""
    status = extract_status(rows, out, order, prefix)
    if report:
        status.write.mode("overwrite").parquet(report)
    return status.filter(F.col("status") == WRITTEN).count()
