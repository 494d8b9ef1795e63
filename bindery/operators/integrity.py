"""Manifests of what was packed, and checks of what was unpacked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import integrity, text
from bindery.operators import packing
from bindery.operators.unpacking import TEXT

# Outcomes of a check.
OK, MISMATCH, UNSIGNED, MISSING, UNCHECKED = "OK", "MISMATCH", "UNSIGNED", "MISSING", "UNCHECKED"


class VerificationError(ValueError):
    """At least one frame failed its check."""


def integrity_manifest(
    files: DataFrame, key: bytes | None = None, squeezed: bool = True
) -> DataFrame:
    """`bundle, seq, path, size, sha256, raw_sha256` of the text files.

    `sha256` covers the canonical text (keyed when a key is given), so a file
    whose line ends were normalised still verifies; `raw_sha256` covers the
    bytes as read. Binary files are never signed. No shuffle.
    """
    texts = files.filter(~text.is_binary(F.col("content")))
    return texts.withColumn("body", text.canonical_text(F.col("content"), squeezed)).select(
        "bundle",
        "seq",
        "path",
        "size",
        integrity.content_digest(packing.signed_text(squeezed), key).alias("sha256"),
        F.sha2("content", 256).alias("raw_sha256"),
    )


def frame_digests(unpacked: DataFrame, key: bytes | None = None) -> DataFrame:
    """`bundle, seq, path, sha256` of the text frames."""
    return unpacked.filter(F.col("kind") == TEXT).select(
        "bundle", "seq", "path", integrity.content_digest(F.col("body"), key).alias("sha256")
    )


def verify(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """`bundle, path, status` of every file in the frames or in the manifest.

    Both sides are first reduced to the last entry of each path, the one that
    extraction keeps; that settles duplicates before the join and leaves one
    row a side per key. Only digests are shuffled, never content.
    """

    def latest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("bundle", "path").agg(F.max_by("sha256", "seq").alias(name))

    found, expected = F.col("found"), F.col("expected")
    status = (
        F.when(found.isNull(), F.lit(MISSING))
        .when(expected.isNull(), F.lit(UNSIGNED))
        .when(found == expected, F.lit(OK))
        .otherwise(F.lit(MISMATCH))
    )
    return (
        latest(digests, "found")
        .join(latest(manifest, "expected"), ["bundle", "path"], "full_outer")
        .select("bundle", "path", status.alias("status"))
    )


def verify_signatures(unpacked: DataFrame, key: bytes | None = None) -> DataFrame:
    """Check each text frame against the signature in its own header.

    Adds `status`; no shuffle. A signature that is not one of our digests is
    UNCHECKED.
    """
    given = F.col("signature")
    status = (
        F.when(given.isNull(), F.lit(UNSIGNED))
        .when(~integrity.is_digest(given), F.lit(UNCHECKED))
        .when(given == integrity.signature(F.col("body"), key), F.lit(OK))
        .otherwise(F.lit(MISMATCH))
    )
    return unpacked.filter(F.col("kind") == TEXT).withColumn("status", status)


def status_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def extract_policy(
    checked: DataFrame, on_fail: str = "abort", unsigned: str = "keep"
) -> tuple[DataFrame, DataFrame]:
    """Split checked frames into (to extract, quarantined).

    `abort` looks for a failure before anything is written and raises, also for a file
    that is `MISSING`; `quarantine` sets failures aside. Unsigned frames are extracted,
    or count as failures where `unsigned` is `refuse`.
    """
    if on_fail not in ("abort", "quarantine"):
        raise ValueError(f"on_fail must be 'abort' or 'quarantine', not {on_fail!r}")
    if unsigned not in ("keep", "refuse"):
        raise ValueError(f"unsigned must be 'keep' or 'refuse', not {unsigned!r}")
    refused = [UNSIGNED] if unsigned == "refuse" else []
    failed = F.col("status").isin(MISMATCH, UNCHECKED, *refused)
    bad = checked.filter(failed)
    if on_fail == "abort":
        first = checked.filter(failed | (F.col("status") == MISSING)).select("bundle", "path", "status").first()
        if first:
            raise VerificationError(f"{first.path} in {first.bundle} is {first.status}")
    return checked.filter(~failed & (F.col("status") != MISSING)), bad
