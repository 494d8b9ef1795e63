"""Bundle text back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import frames, integrity, text
from bindery.scratch import materialize

# What a record of a bundle is.
TEXT, BINARY, KEY, BAD_HEADER = "text", "binary", "key", "bad_header"


class EmptyBundleError(ValueError):
    """No file could be extracted."""


def parse_records(records: DataFrame) -> DataFrame:
    """Replace `record` with `path, signature, kind, body`; other columns stay.

    A malformed header gives a `bad_header` row instead of ending the job.
    Line ends may be CRLF.
    """
    record = F.col("record")
    header, binary = frames.record_header(record), frames.record_is_binary(record)
    is_key, path = frames.is_key_header(header), frames.header_path(header)
    kind = (
        F.when(is_key, F.lit(KEY))
        .when(path.isNull(), F.lit(BAD_HEADER))
        .when(binary, F.lit(BINARY))
        .otherwise(F.lit(TEXT))
    )
    body = F.when(is_key, frames.header_key(header)).when(~binary, frames.record_body(record))
    return records.select(
        *(c for c in records.columns if c != "record"),
        F.when(is_key, F.lit(frames.KEY_PATH)).otherwise(path).alias("path"),
        frames.header_signature(header).alias("signature"),
        kind.alias("kind"),
        body.alias("body"),
    )


def unpack(bundles: DataFrame, text_column: str = "text") -> DataFrame:
    """`bundle, seq, path, signature, kind, body` from bundle or shard texts.

    Text before the first header and after a fence is ignored. With a `shard`
    column, `seq` orders frames over all shards of a bundle.
    """
    framed = F.concat(F.lit(text.LF), text.without_final_lf(F.col(text_column)))
    shard = F.col("shard").cast("long") if "shard" in bundles.columns else F.lit(0).cast("long")
    pieces = bundles.select(
        "bundle", shard.alias("_shard"), F.posexplode(F.split(framed, frames.FRAME_BREAK))
    ).filter(F.col("pos") > 0)
    records = pieces.select(
        "bundle",
        (F.shiftleft(F.col("_shard"), 31) + F.col("pos")).alias("seq"),
        F.col("col").alias("record"),
    )
    return parse_records(records)


def text_frames(unpacked: DataFrame) -> DataFrame:
    """The frames that stand for files: `kind` is text."""
    return unpacked.filter(F.col("kind") == TEXT)


def key_blocks(unpacked: DataFrame) -> DataFrame:
    """`bundle, key, valid`: one row per key block; bad keys are marked."""
    key = F.col("body")
    decoded = F.try_to_binary(key, F.lit("base64"))
    valid = F.coalesce(F.octet_length(decoded) == frames.KEY_BYTES, F.lit(False))
    return unpacked.filter(F.col("kind") == KEY).select(
        "bundle", key.alias("key"), valid.alias("valid")
    )


def restore(unpacked: DataFrame) -> DataFrame:
    """Replace `body` with `content`, the text of the extracted file."""
    return (
        text_frames(unpacked)
        .withColumn("content", text.restore_text(F.col("body")))
        .drop("body", "kind")
    )


def last_wins(rows: DataFrame, order: Column | str = "seq") -> DataFrame:
    """Last row per (bundle, path); `order` is unique within a path.

    Only keys are reduced: paths that repeat, of which there are few, are written as a
    table with their last place, and the rows before it are filtered out. Content stays
    where it is as long as that table is small enough to be broadcast by its size.
    """
    order = F.col(order) if isinstance(order, str) else order
    others = [c for c in rows.columns if c not in ("bundle", "path")]
    placed = rows.withColumn("_place", order)
    repeated = placed.groupBy("bundle", "path").agg(
        F.max("_place").alias("_last"), F.count(F.lit(1)).alias("_rows")
    )
    repeated = materialize(repeated.filter(F.col("_rows") > 1), "repeated").select(
        F.col("bundle").alias("_bundle"), F.col("path").alias("_path"), "_last"
    )
    same = F.col("bundle").eqNullSafe(F.col("_bundle")) & F.col("path").eqNullSafe(F.col("_path"))
    joined = placed.join(repeated, same, "left")
    last = F.col("_last").isNull() | (F.col("_place") == F.col("_last"))
    return joined.filter(last).select("bundle", "path", *others)


def extract_counts(unpacked: DataFrame) -> DataFrame:
    """Files to extract per bundle, with the frames that yield none."""
    return unpacked.groupBy("bundle").agg(
        F.count_if(F.col("kind") == TEXT).alias("extracted"),
        F.count_if(F.col("kind") == BINARY).alias("binary"),
        F.count_if(F.col("kind") == BAD_HEADER).alias("bad_header"),
    )


def require_files(unpacked: DataFrame) -> DataFrame:
    """Raise when nothing can be extracted; runs a one-row job."""
    if text_frames(unpacked).isEmpty():
        raise EmptyBundleError("no files were extracted")
    return unpacked


def bundle_audit(files: DataFrame) -> DataFrame:
    """Per file: would its frame be misread, is it UTF-8, does a round trip
    change it, would its path be read as another. Reads each file once, no shuffle.

    Null content has no frame and is `lossy`; a null path is a `bad_path`.
    """
    content = F.col("content")
    body = text.canonical_text(content)
    restored = text.restore_text(F.col("_body")).cast("binary")
    return (
        files.withColumn("_body", body)
        .withColumn("collides", frames.collides(F.col("_body")))
        .withColumn("not_utf8", ~F.coalesce(text.is_utf8(content), F.lit(True)))
        .withColumn("lossy", ~restored.eqNullSafe(content))
        .withColumn("bad_path", ~frames.path_survives(F.col("path")))
        .drop("_body")
    )
