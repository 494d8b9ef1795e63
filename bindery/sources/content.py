"""Bytes of catalogued files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from bindery import stores
from bindery.operators.catalog import with_path_parts
from bindery.sizing import tasks_for_bytes
from bindery.sources.walk import catalog_walk, spark_omits

_BATCH_BYTES = 32 * 1024 * 1024


def read_content(catalog: DataFrame) -> DataFrame:
    """Add `content` and `failed` to catalog rows; filter the catalog first.

    The rows are dealt out to as many tasks as the bytes ask for, and read in
    batches limited by bytes. A file that cannot be read gives null content and
    `failed` true.
    """
    schema = ST.StructType(
        [
            *catalog.schema.fields,
            ST.StructField("content", ST.BinaryType()),
            ST.StructField("failed", ST.BooleanType()),
        ]
    )
    limit = _BATCH_BYTES

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def take(batch, start, contents):
            part = batch.iloc[start : start + len(contents)].copy()
            part["content"] = pd.Series(contents, index=part.index, dtype=object)
            part["failed"] = [c is None for c in contents]
            return part

        for batch in batches:
            start, contents, held = 0, [], 0
            raws = batch["raw"] if "raw" in batch else [None] * len(batch)
            for path, raw in zip(batch["path"], raws):
                try:
                    with open(stores.local_path(path) if raw is None else raw, "rb") as source:
                        contents.append(source.read())
                except (OSError, ValueError):
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held >= limit:
                    yield take(batch, start, contents)
                    start, contents, held = start + len(contents), [], 0
            if contents:
                yield take(batch, start, contents)

    return catalog.repartition(tasks_for_bytes(catalog)).mapInPandas(read_files, schema)


def _local_roots(spark: SparkSession, paths: str | list[str]) -> list[str] | None:
    """The arguments as local paths, or None where Spark's own source has to list them.

    That is so for other stores, globs, missing paths, of which it tells, and sessions that
    pass over lost or corrupt files.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    lenient = (f"spark.sql.files.ignore{what}Files" for what in ("Missing", "Corrupt"))
    jvm = getattr(spark, "_jvm", None)
    if jvm is None or not given or any(spark.conf.get(name) == "true" for name in lenient):
        return None
    conf, roots = spark._jsparkSession.sessionState().newHadoopConf(), {}
    for path in given:
        if any(mark in path for mark in "{}[]*?\\"):
            return None
        place = jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(conf)
        local = store.makeQualified(place).toUri().getPath()
        if store.getScheme() != "file" or not os.path.exists(local):
            return None
        if os.path.isdir(local) or not spark_omits()(os.fsencode(os.path.basename(local)), False):
            roots[local] = None
    return list(roots)


def _reader():
    """Column function from `path, raw` to the bytes of local files, in batches limited by bytes.

    Bytes that do not agree with the checksums that Hadoop keeps beside a file raise.
    """
    limit = _BATCH_BYTES

    def read_files(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import os
        import zlib

        def check(place, content):
            folder, name = os.path.split(os.fsencode(place))
            try:
                with open(os.path.join(folder, b"." + name + b".crc"), "rb") as source:
                    known = source.read()
            except OSError:
                return
            step = int.from_bytes(known[4:8], "big")
            if known[:4] != b"crc\0" or not step:
                return
            cuts = range(0, len(content), step)
            view = memoryview(content)
            sums = b"".join(zlib.crc32(view[i : i + step]).to_bytes(4, "big") for i in cuts)
            if known[8 : 8 + len(sums)] != sums:
                raise OSError(f"checksum error: {place}")

        for paths, raws in batches:
            contents, held = [], 0
            for path, raw in zip(paths.to_pylist(), raws.to_pylist()):
                place = path if raw is None else raw
                with open(place, "rb") as source:
                    contents.append(source.read())
                check(place, contents[-1])
                held += len(contents[-1])
                if held >= limit:
                    yield pa.array(contents, pa.binary())
                    contents, held = [], 0
            if contents:
                yield pa.array(contents, pa.binary())

    return F.arrow_udf(read_files, ST.BinaryType())


def read_binary_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`path, base_name, ext, size, content` as Spark's own file source gives them.

    Names that begin with `.` or `_` and empty files do not appear. Size filters come
    before reading and unused content is not read. Local folders are listed and read by
    tasks, and the driver never holds their files' names; object stores, and globs, go
    through Spark's own source, which lists all files on the driver.
    """
    roots = _local_roots(spark, paths)
    if roots is None:
        source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        return with_path_parts(
            source.select("path", F.col("length").alias("size"), "content")
        )
    found = catalog_walk(spark, roots, like_spark=True).filter("size > 0").select("path", "raw", "size")
    if len(roots) > 1:
        found = found.distinct()  # one argument within another
    dealt = found.repartition(tasks_for_bytes(found))
    return with_path_parts(
        dealt.select(
            F.concat(F.lit("file:"), "path").alias("path"), "size", _reader()("path", "raw").alias("content")
        )
    )
