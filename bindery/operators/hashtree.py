"""A hash tree over a manifest: one root digest stands for all its files.

A file's key is the digest of its bundle and path in hexadecimal digits; the first digits
of the key name its leaf bucket, and each further digit that is left out names the node
above, up to the root, whose name is empty. A bucket's digest covers the sorted digests
of its files, a node's those of its children with their names. So a missing, added,
changed or exchanged file alters the root.

The root is kept apart from the bundle. To verify, the buckets of what was found are
digested and compared with the stored ones; only the entries of buckets that differ are
joined by path.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import integrity as digests
from bindery.operators.integrity import MISMATCH, MISSING, UNSIGNED, OK, VerificationError
from bindery.scratch import materialize

#: Files of a bucket on average, at most.
BUCKET_FILES = 1_024
#: Digits of the longest bucket name: 16^7 buckets for some 10^11 files.
MOST_DIGITS = 7


@dataclass(frozen=True)
class HashTree:
    """`entries`: `bundle, path, sha256, node, leaf`, a row for each file, last wins;
    `nodes`: `level, node, digest, files`, the root at level 0; `root`: its digest."""

    entries: DataFrame
    nodes: DataFrame
    root: str
    digits: int


def _entries(listed: DataFrame, digits: int, key: bytes | None) -> DataFrame:
    """Tree entries of `bundle, seq, path, sha256`; of a repeated path the last counts."""
    last = listed.groupBy("bundle", "path").agg(F.max_by("sha256", "seq").alias("sha256"))
    named = F.concat(F.length("bundle"), F.lit(":"), "bundle", "path")
    name = F.sha2(named.cast("binary"), 256)
    last = last.select("*", name.alias("_key"))
    return last.select(
        "bundle",
        "path",
        "sha256",
        F.substring("_key", 1, digits).alias("node"),
        digests.content_digest(F.concat_ws(":", "_key", "sha256"), key).alias("leaf"),
    )


def _folded(rows: DataFrame, name: Column, parts: Column, files: Column, key: bytes | None) -> DataFrame:
    """`node, digest, files`: each group's sorted `parts` under one digest."""
    held = F.array_join(F.array_sort(F.collect_list(parts)), "")
    folded = rows.groupBy(name.alias("node")).agg(held.alias("_held"), files.alias("files"))
    return folded.select("node", digests.content_digest(F.col("_held"), key).alias("digest"), "files")


def _buckets(entries: DataFrame, key: bytes | None) -> DataFrame:
    return _folded(entries, F.col("node"), F.col("leaf"), F.count(F.lit(1)), key)


def _levels(buckets: DataFrame, digits: int, key: bytes | None) -> DataFrame:
    """`level, node, digest, files` of the buckets and all nodes above them."""
    level, tree = buckets, buckets.withColumn("level", F.lit(digits))
    for above in range(digits - 1, -1, -1):
        level = _folded(
            level, F.substring("node", 1, above), F.concat_ws(":", "node", "digest"), F.sum("files"), key
        )
        tree = tree.unionByName(level.withColumn("level", F.lit(above)))
    return tree.select("level", "node", "digest", "files")


def empty_root(key: bytes | None = None) -> str:
    """The root over no file."""
    return hmac.new(key, b"", hashlib.sha256).hexdigest() if key else hashlib.sha256(b"").hexdigest()


def digits_for(files: int) -> int:
    digits = 1
    while 16**digits * BUCKET_FILES < files and digits < MOST_DIGITS:
        digits += 1
    return digits


def _root_of(nodes: DataFrame, key: bytes | None) -> str:
    found = nodes.where("level = 0").select("digest").first()
    return found[0] if found else empty_root(key)


def hash_tree(manifest: DataFrame, key: bytes | None = None, digits: int | None = None) -> HashTree:
    """The tree over a manifest's `bundle, seq, path, sha256`, as written tables.

    With a `key` all digests are keyed. One shuffle folds repeated paths, one groups
    entries by bucket; a bucket holds `BUCKET_FILES` entries or so, whatever the bundles,
    since names spread by their digest. Nodes above are a sixteenth each time. Null
    bundles and paths count as empty.
    """
    listed = manifest.select(
        F.coalesce("bundle", F.lit("")).alias("bundle"), "seq", F.coalesce("path", F.lit("")).alias("path"), "sha256"
    )
    if digits is None:
        digits = digits_for(listed.count())
    entries = materialize(_entries(listed, digits, key).repartition("node").sortWithinPartitions("node"), "entries")
    buckets = materialize(_buckets(entries, key), "buckets")
    nodes = materialize(_levels(buckets, digits, key), "nodes")
    return HashTree(entries, nodes, _root_of(nodes, key), digits)


def write_tree(tree: HashTree, path: str) -> str:
    """Entries and nodes as tables under `path`; returns the root, to be kept elsewhere."""
    tree.entries.write.parquet(f"{path}/entries")
    tree.nodes.write.parquet(f"{path}/nodes")
    return tree.root


def read_tree(spark: SparkSession, path: str, key: bytes | None = None) -> HashTree:
    entries, nodes = spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/nodes")
    digits = nodes.agg(F.max("level")).first()[0] or 1
    return HashTree(entries, nodes, _root_of(nodes, key), digits)


def verify_root(
    found: DataFrame, tree: HashTree, root: str, key: bytes | None = None
) -> DataFrame:
    """`bundle, path, status` of every file that is not as the root says; none if all are.

    `found` are digests as `integrity.frame_digests` gives them: `bundle, seq, path,
    sha256`. `MISSING`, `UNSIGNED` and `MISMATCH` as in `integrity.verify`. The stored tree
    is trusted only as far as `root` covers it: nodes that do not fold to `root`, or
    entries of a differing bucket that do not fold to its digest, raise
    `VerificationError`.

    What was found is folded by bucket in one shuffle of digests; buckets are compared
    by name, and only entries of differing ones go into the join by path.
    """
    buckets = tree.nodes.where(F.col("level") == tree.digits).select("node", "digest", "files")
    folded = _levels(buckets, tree.digits, key).where("level = 0").select("digest").first()
    if (folded[0] if folded else empty_root(key)) != root:
        raise VerificationError("the hash tree does not have this root")
    listed = found.select(
        F.coalesce("bundle", F.lit("")).alias("bundle"), "seq", F.coalesce("path", F.lit("")).alias("path"), "sha256"
    )
    own = materialize(_entries(listed, tree.digits, key).repartition("node"), "found")
    present = _buckets(own, key).select("node", F.col("digest").alias("own"))
    differ = buckets.join(present, "node", "full_outer").where(~F.col("digest").eqNullSafe(F.col("own")))
    differ = materialize(differ.select("node", "digest"), "differing")

    stored = tree.entries.join(differ.select("node"), "node", "left_semi").select("bundle", "path", "sha256")
    stored = _entries(stored.withColumn("seq", F.lit(0)), tree.digits, key)  # leaves are made anew
    checked = _buckets(stored, key).select("node", F.col("digest").alias("stored"))
    forged = differ.join(checked, "node", "left").where(~F.col("digest").eqNullSafe(F.col("stored")))
    if not forged.isEmpty():
        raise VerificationError("entries of the hash tree were changed")

    here = own.join(differ.select("node"), "node", "left_semi").select("bundle", "path", F.col("sha256").alias("_own"))
    there = stored.select("bundle", "path", F.col("sha256").alias("_stored"))
    status = (
        F.when(F.col("_own").isNull(), F.lit(MISSING))
        .when(F.col("_stored").isNull(), F.lit(UNSIGNED))
        .when(F.col("_own") == F.col("_stored"), F.lit(OK))
        .otherwise(F.lit(MISMATCH))
    )
    joined = here.join(there, ["bundle", "path"], "full_outer")
    return joined.select("bundle", "path", status.alias("status")).where(F.col("status") != OK)
