"""Files to bundles, end to end."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bindery.config import PackConfig
from bindery.operators import admission, integrity, packing
from bindery.scratch import materialize
from bindery.sinks.bundles import write_manifest, write_planned
from bindery.sources.content import read_content
from bindery.sources.walk import catalog, catalog_manifest, catalog_paths


class NoInputError(ValueError):
    """No file passed the admission rules."""


def planned_frames(
    files: DataFrame, cfg: PackConfig, listed: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """`bundle, shard, task, seq, path, frame, …` of admitted files with content, and the
    number of tasks.

    `listed` is the same set of files from a source without content, where
    there is one: shards and tasks are planned from it, and content is read once.
    """
    rendered = packing.render(files, cfg.squeeze, cfg.signed, cfg.key)
    return packing.assign_tasks(rendered, files if listed is None else listed, cfg.shard_bytes)


def _write(
    admitted: DataFrame, cfg: PackConfig, out: str, listed: DataFrame | None = None
) -> dict[str, int]:
    """Bundles under `out/bundles`; for signed runs the manifest under
    `out/manifest`."""
    counters = write_planned(*planned_frames(admitted, cfg, listed), f"{out}/bundles")
    if not counters["files"]:
        raise NoInputError("no file matched the criteria")
    if cfg.signed:
        manifest = integrity.integrity_manifest(admitted, cfg.key, cfg.squeeze)
        write_manifest(manifest, f"{out}/manifest")
    return counters


def _report(
    files: DataFrame, cfg: PackConfig, out: str, missing: int = 0, unread: tuple[int, int] = (0, 0)
) -> None:
    """`reason, files, bytes` under `out/report`, from catalog columns alone; `missing`
    counts arguments and listed names without a file, and `unread` files and bytes that
    were admitted but could not be read."""
    counts = admission.admission_counts(admission.with_reason(files, cfg))
    known = [(admission.MISSING, missing, 0)] if missing else []
    if unread[0]:
        known += [(admission.OK, -unread[0], -unread[1]), (admission.UNREADABLE, *unread)]
    if known:
        more = files.sparkSession.createDataFrame(known, "reason string, files long, bytes long")
        counts = counts.unionByName(more).groupBy("reason").agg(
            F.sum("files").alias("files"), F.sum("bytes").alias("bytes")
        )
    counts.filter("files > 0").coalesce(1).write.mode("overwrite").parquet(f"{out}/report")


def pack_files(files: DataFrame, cfg: PackConfig, out: str) -> dict[str, int]:
    """Admit, render and write `files` that already have content.

    Every run reports its reasons under `out/report`, also one that raises `NoInputError`.
    """
    _report(files, cfg, out)
    return _write(admission.admit(files, cfg), cfg, out)


def _pack_catalog(
    listed: DataFrame, cfg: PackConfig, out: str, missing: int
) -> dict[str, int]:
    """Admission on catalog rows first, so only admitted files are read."""
    _report(listed, cfg, out, missing)
    admitted = materialize(admission.admit(listed, cfg), "admitted")
    if admitted.isEmpty():
        raise NoInputError("no file matched the criteria")
    watch = Observation()
    unread = F.col("failed")
    read = read_content(admitted).observe(
        watch, F.count_if(unread).alias("files"), F.sum(F.when(unread, F.col("size"))).alias("bytes")
    )
    try:
        counters = _write(read.filter(~unread), cfg, out, listed=admitted)
        written = counters["files"]
    except NoInputError:
        written = 0
    failed = admitted.count() - written
    if failed:
        try:
            seen = watch.get
        except Py4JJavaError:  # none of a plan that Spark finds to be empty while running
            seen = {}
        if seen.get("files") != failed:  # or a lost executor's tasks were counted twice
            lost = read_content(admitted).filter(unread)
            seen = {"bytes": lost.agg(F.sum("size")).first()[0]}
        _report(listed, cfg, out, missing, (failed, seen["bytes"] or 0))
    if not written:
        raise NoInputError("no file could be read")
    return {**counters, "failed": failed}


def pack_paths(
    spark: SparkSession, roots: Iterable[str], cfg: PackConfig, out: str, name: str
) -> dict[str, int]:
    """Pack files and directories into the bundle `name` under `out`."""
    roots = list(roots)
    missing = catalog_paths(spark, roots).filter("not exists").count()
    listed = catalog(
        spark,
        roots,
        name,
        recursive=cfg.recursive,
        include_hidden=cfg.include_hidden,
        exclude=[out],
    )
    return _pack_catalog(listed, cfg, out, missing)


def pack_manifest(
    spark: SparkSession, root: str, tracked: DataFrame, cfg: PackConfig, out: str, name: str
) -> dict[str, int]:
    """Pack the files of a tracked list (column `path`) that exist under `root`."""
    listed = catalog_manifest(spark, root, tracked, name)
    return _pack_catalog(listed, cfg, out, tracked.count() - listed.count())
