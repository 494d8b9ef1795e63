"""Catalogs of real files: directory walks and explicit paths.

Spark's own file sources leave out names that begin with `.` or `_` and files
without bytes, so listing is done by tasks over a DataFrame of directories.
Paths are local or on a mount that all executors share, or `file:` URIs of such;
other schemes raise `ValueError`. A path that is not UTF-8 is shown with replacement
characters, and its bytes are in `raw`, which is null otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery import stores
from bindery.operators.catalog import assign_seq, with_path_parts
from bindery.scratch import materialize
from bindery.sizing import task_count

_LISTING = (
    "arg int, path string, kind string, size long, mtime double, hidden_tree boolean, "
    "real binary, trail array<binary>, raw binary"
)
_COLUMNS = ["arg", "path", "kind", "size", "mtime", "hidden_tree", "real", "trail", "raw"]
CATALOG_COLUMNS = ["arg", "path", "base_name", "ext", "size", "mtime", "hidden_tree", "raw"]
_BATCH_ROWS = 10_000


def spark_omits():
    """Whether Spark's file sources leave out a name: a test of its bytes, for a folder or a file."""

    def omits(name: bytes, folder: bool) -> bool:
        reserved = name.startswith(b"_") and b"=" not in name
        if reserved and not folder:
            return True
        omitted = reserved or name.startswith(b".") or name.endswith(b"._COPYING_")
        return omitted and not name.startswith((b"_metadata", b"_common_metadata"))

    return omits


def _lister(
    include_hidden: bool,
    exclude: tuple[str, ...],
    on_error: str,
    batch_rows: int,
    like_spark: bool = False,
):
    """Task body: one row per directory in, one row per entry out.

    Entries stream out in batches, so a directory of any length fits.
    """
    omits = spark_omits()

    def list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        outside = [os.fsencode(e) for e in exclude]

        def shown(raw):
            """A path as text, and its bytes where the text is not the same."""
            text = raw.decode("utf-8", "replace")
            return text, None if text.encode("utf-8") == raw else raw

        def entries(row):
            given = row.raw if row.raw is not None else os.fsencode(row.path)
            try:
                found = os.scandir(given)
            except OSError:
                if on_error == "raise":
                    raise
                yield (row.arg, row.path, "unreadable", None, None, row.hidden_tree, None, None, row.raw)
                return
            with found:
                for entry in found:
                    hidden = entry.name.startswith(b".")
                    if hidden and not include_hidden:
                        continue
                    if like_spark and omits(entry.name, entry.is_dir()):
                        continue
                    real = os.path.realpath(entry.path)
                    if any(real == e or real.startswith(e + b"/") for e in outside):
                        continue
                    in_hidden = bool(row.hidden_tree or hidden)
                    path, raw = shown(entry.path)
                    if entry.is_dir():
                        trail = list(row.trail)
                        if entry.is_symlink():
                            trail.append(row.real)
                            if any((t + b"/").startswith(real.rstrip(b"/") + b"/") for t in trail):
                                continue  # a link back to a directory above
                        yield (row.arg, path, "dir", None, None, in_hidden, real, trail, raw)
                    elif entry.is_file():
                        try:
                            stat = entry.stat()
                        except FileNotFoundError:
                            continue  # gone since it was listed
                        yield (
                            row.arg, path, "file", stat.st_size, stat.st_mtime,
                            in_hidden, real, None, raw,
                        )

        def frame(rows):
            out = pd.DataFrame(rows, columns=_COLUMNS)
            return out.astype({"size": "Int64"})

        pending = []
        for batch in batches:
            for row in batch.itertuples():
                for entry in entries(row):
                    pending.append(entry)
                    if len(pending) >= batch_rows:
                        yield frame(pending)
                        pending = []
        if pending:
            yield frame(pending)

    return list_directories


def _stater():
    def stat_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            rows = []
            for row in batch.itertuples():
                path = stores.local_path(row.path)
                kind = (
                    "dir" if os.path.isdir(path) else "file" if os.path.isfile(path) else "missing"
                )
                stat = os.stat(path) if kind == "file" else None
                rows.append(
                    (
                        row.arg, row.path, kind, stat and stat.st_size, stat and stat.st_mtime, False,
                        os.fsencode(os.path.realpath(path)), [], None,
                    )
                )
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"size": "Int64"})

    return stat_paths


def _arguments(spark: SparkSession, paths: Iterable[str] | DataFrame) -> DataFrame:
    """Explicit arguments as `arg, path`; a DataFrame passes as it is."""
    if isinstance(paths, DataFrame):
        named = paths.select(F.col("arg").cast("int"), "path")
        return named.repartition(task_count(spark))
    rows = list(enumerate(paths))
    return spark.createDataFrame(rows, "arg int, path string")


def catalog_paths(spark: SparkSession, paths: Iterable[str] | DataFrame) -> DataFrame:
    """`arg, path, exists, is_file, size, mtime` for explicitly named paths.

    A missing path is a row with `exists` false, not an error. A path given
    twice is there twice.
    """
    stated = _arguments(spark, paths).mapInPandas(_stater(), _LISTING)
    return stated.select(
        "arg",
        "path",
        (F.col("kind") != "missing").alias("exists"),
        (F.col("kind") == "file").alias("is_file"),
        "size",
        "mtime",
    )


def _walk(
    roots: DataFrame,
    include_hidden: bool,
    exclude: Iterable[str],
    on_error: str,
    like_spark: bool = False,
):
    """Listing rounds, one per level of the tree; each is a written table."""
    outside = tuple(e.rstrip("/") for e in exclude)
    lister = _lister(include_hidden, outside, on_error, _BATCH_ROWS, like_spark)
    level, found = roots, []
    while True:
        listed = materialize(
            level.repartition(task_count(level.sparkSession), "path").mapInPandas(
                lister, _LISTING
            ),
            "walk",
        )
        found.append(listed.filter(F.col("kind") == "file"))
        level = listed.filter(F.col("kind") == "dir")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def catalog_walk(
    spark: SparkSession,
    roots: Iterable[str],
    recursive: bool = True,
    include_hidden: bool = False,
    exclude: Iterable[str] = (),
    on_error: str = "raise",
    like_spark: bool = False,
) -> DataFrame:
    """Files under the given arguments: `arg, path, base_name, ext, size,
    mtime, hidden_tree`.

    A directory is walked when `recursive` is set and left out otherwise; a
    file is taken as it is; a missing path is left out. Hidden entries are
    pruned before they are listed. Links are followed, except back to a
    directory above. `exclude` names trees, such as the output folder, that
    are never listed.
    """
    import os

    roots = [stores.local_path(root) for root in roots]
    stated = materialize(_arguments(spark, roots).mapInPandas(_stater(), _LISTING), "args")
    files = stated.filter(F.col("kind") == "file")
    directories = stated.filter(F.col("kind") == "dir")
    if recursive and not directories.isEmpty():
        hidden_out = [os.path.realpath(stores.local_path(e)) for e in exclude]
        files = files.unionByName(_walk(directories, include_hidden, hidden_out, on_error, like_spark))
    return with_path_parts(files).select(*CATALOG_COLUMNS)


def catalog(spark: SparkSession, roots: Iterable[str], bundle: str, **options) -> DataFrame:
    """`catalog_walk` with `seq` (argument order, then path) and one `bundle`."""
    ordered = assign_seq(catalog_walk(spark, roots, **options), "arg", "path")
    return ordered.withColumn("bundle", F.lit(bundle))


def catalog_manifest(
    spark: SparkSession, root: str, tracked: DataFrame, bundle: str
) -> DataFrame:
    """Catalog of a tracked-file list (column `path`, relative to `root`).

    Names without a regular file drop out, repeats stay, and files in hidden
    directories stay too: the list decides.
    """
    named = tracked.select(
        F.lit(0).alias("arg"), F.concat(F.lit(stores.local_path(root).rstrip("/") + "/"), F.col("path")).alias("path")
    )
    present = materialize(catalog_paths(spark, named).filter("is_file"), "manifest")
    present = present.withColumn("hidden_tree", F.lit(False)).withColumn("raw", F.lit(None).cast("binary"))
    with_parts = with_path_parts(present)
    ordered = assign_seq(with_parts.select(*CATALOG_COLUMNS), "arg", "path")
    return ordered.withColumn("bundle", F.lit(bundle))
