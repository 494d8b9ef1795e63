"""Bundles to files, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import paths
from bindery.functions.integrity import content_digest
from bindery.operators import integrity, unpacking
from bindery.scratch import materialize
from bindery.sinks.files import WRITTEN
from bindery.sinks.staged import decide, latest, publish, stage
from bindery.sources.bundles import read_bundles


def unpack_bundles(
    spark: SparkSession,
    bundles: str | list[str],
    out: str,
    manifest: DataFrame | None = None,
    signed: bool = False,
    key: bytes | None = None,
    on_fail: str = "abort",
    prefix: str = "",
    foldered: bool = True,
    bundle: str | None = None,
    flat: bool = True,
    report: str | None = None,
    unsigned: str = "keep",
) -> int:
    """Extract bundle files into `out`; returns the number of files written.

    `foldered` is false for plain bundle files outside `write_bundles` folders, whose
    bundle is then called `bundle`, or after the file. `flat` writes the files of all
    bundles into one folder and raises if two bundles have the same path; otherwise
    each bundle gets a folder. `report` names a folder for a table of what became of
    each path.

    Bundles are parsed once: files are staged with their digests beside `out`, all
    checks run on the list of what is staged, and files appear after the last check.
    Only the last frame of a path counts, also for the checks. `signed` checks it
    against its header, `manifest` against a manifest table. Under `abort` a changed
    file raises, and one of the manifest that is missing; then `out` is as it was.
    `unsigned="refuse"` treats files without signature, or outside the manifest, as
    changed ones.
    """
    frames = read_bundles(spark, bundles, foldered)
    if bundle is not None:
        frames = frames.withColumn("bundle", F.lit(bundle))
    texts = unpacking.text_frames(frames)
    carried = []
    if signed:
        texts, carried = integrity.verify_signatures(texts, key), ["status"]
    if manifest is not None:
        texts = texts.withColumn("sha256", content_digest(F.col("body"), key))
        carried = [*carried, "sha256"]
    restored = unpacking.restore(texts)
    staging = stage(restored.select("bundle", "path", "pos", *carried, "content"), out)
    try:
        decided = decide(staging, _checked(staging.listing, manifest, signed, on_fail, unsigned, prefix, flat), "pos", prefix)
    except Exception:
        staging.discard()
        raise
    status = publish(decided, out, staging.folder)
    if report:
        status.write.mode("overwrite").parquet(report)
    return status.filter(F.col("status") == WRITTEN).count()


def _checked(
    listing: DataFrame,
    manifest: DataFrame | None,
    signed: bool,
    on_fail: str,
    unsigned: str,
    prefix: str,
    flat: bool,
) -> DataFrame:
    """The staged files to extract, the last of each path, by the checks asked for."""
    files = materialize(latest(listing, "pos"), "staged")
    if files.isEmpty():
        raise unpacking.EmptyBundleError("no files were extracted")
    if flat:
        target = paths.tidy_path(paths.relative_path(F.col("path"), prefix))
        targets = files.select("bundle", target.alias("path")).distinct()
        shared = targets.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
        if shared:
            raise ValueError(f"several bundles hold {shared.path}; extract with flat=False")
    if signed:
        files, _ = integrity.extract_policy(files, on_fail, unsigned)
    if manifest is not None:
        digests = files.select("bundle", F.col("pos").alias("seq"), "path", "sha256")
        status = integrity.verify(digests, manifest)
        _, bad = integrity.extract_policy(status, on_fail, unsigned)
        files = files.join(bad.select("bundle", "path"), ["bundle", "path"], "left_anti")
    return files.withColumn("bundle", F.lit("")) if flat else files
