"""The hash tree against plain Python, and what it finds."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from bindery.operators import hashtree
from bindery.operators.hashtree import empty_root, hash_tree, read_tree, verify_root, write_tree
from bindery.operators.integrity import VerificationError

SCHEMA = "bundle string, seq long, path string, sha256 string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(n):
    return [(f"b{i % 3}", i, f"p/{i}", sha(f"text {i}")) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_root(rows, digits, key=None):
    def digest(text):
        return hmac.new(key, text.encode(), hashlib.sha256).hexdigest() if key else sha(text)

    last = {(b or "", p or ""): h for b, _, p, h in sorted(rows, key=lambda r: r[1])}
    named = {}
    for (b, p), h in last.items():
        k = sha(f"{len(b)}:{b}{p}")
        named.setdefault(k[:digits], []).append(digest(f"{k}:{h}"))
    level = {node: digest("".join(sorted(leaves))) for node, leaves in named.items()}
    for above in range(digits - 1, -1, -1):
        parts = {}
        for node, d in level.items():
            parts.setdefault(node[:above], []).append(f"{node}:{d}")
        level = {node: digest("".join(sorted(p))) for node, p in parts.items()}
    return level.get("", digest(""))


@pytest.mark.parametrize("digits, key", [(1, None), (2, None), (3, b"secret")])
def test_root_against_plain_version(spark, digits, key):
    rows = rows_of(120) + [("b0", 500, "p/0", sha("later")), (None, 7, None, sha("n")), ("a\nb", 8, "c", sha("x"))]
    tree = hash_tree(frame(spark, rows), key, digits)
    assert tree.root == plain_root(rows, digits, key)
    levels = tree.nodes.groupBy("level").agg(F.sum("files").alias("n")).collect()
    assert {r["level"]: r.n for r in levels} == dict.fromkeys(range(digits + 1), 122)


def test_one_missing_one_forged_one_changed(spark, tmp_path):
    rows = rows_of(200)
    root = write_tree(hash_tree(frame(spark, rows), b"k", 2), str(tmp_path / "tree"))
    tree = read_tree(spark, str(tmp_path / "tree"), b"k")
    assert (tree.root, tree.digits) == (root, 2)
    assert verify_root(frame(spark, rows), tree, root, b"k").count() == 0
    b, s, p, _ = rows[6]
    bad = rows[:5] + [(b, s, p, sha("other"))] + rows[7:] + [("b9", 1, "evil", sha("e"))]
    found = {(r.bundle, r.path): r.status for r in verify_root(frame(spark, bad), tree, root, b"k").collect()}
    assert found == {("b2", "p/5"): "MISSING", (b, p): "MISMATCH", ("b9", "evil"): "UNSIGNED"}


def test_exchanged_contents_are_found(spark):
    rows = rows_of(50)
    tree = hash_tree(frame(spark, rows))
    swapped = [(*rows[0][:3], rows[1][3]), (*rows[1][:3], rows[0][3]), *rows[2:]]
    assert hash_tree(frame(spark, swapped)).root != tree.root
    assert verify_root(frame(spark, swapped), tree, tree.root).count() == 2


def test_the_tree_itself_is_checked(spark):
    rows = rows_of(60)
    tree = hash_tree(frame(spark, rows), digits=2)
    with pytest.raises(VerificationError, match="root"):
        verify_root(frame(spark, rows), tree, "0" * 64)
    changed = tree.entries.withColumn("sha256", F.when(F.col("path") == "p/3", F.lit("f" * 64)).otherwise(F.col("sha256")))
    forged = hashtree.HashTree(changed, tree.nodes, tree.root, 2)
    assert verify_root(frame(spark, rows), forged, tree.root).count() == 0  # its bucket is as the root says
    with pytest.raises(VerificationError, match="entries"):
        verify_root(frame(spark, rows[:3] + rows[4:]), forged, tree.root)


def test_a_swapped_digest_beside_its_leaf_is_checked(spark):
    """The stored digest of an entry has to be the one its leaf was made of."""
    rows = rows_of(40)
    tree = hash_tree(frame(spark, rows), digits=1)
    other = F.when(F.col("path") == "p/3", F.lit(sha("evil"))).otherwise(F.col("sha256"))
    forged = hashtree.HashTree(tree.entries.withColumn("sha256", other), tree.nodes, tree.root, 1)
    found = [r if r[1] != 3 else (*r[:3], sha("evil")) for r in rows]
    with pytest.raises(VerificationError, match="entries"):
        verify_root(frame(spark, found), forged, tree.root)


def test_empty_manifest(spark):
    tree = hash_tree(frame(spark, []))
    assert tree.root == empty_root() and hash_tree(frame(spark, []), b"k").root == empty_root(b"k")
    assert verify_root(frame(spark, []), tree, tree.root).count() == 0
    found = verify_root(frame(spark, rows_of(1)), tree, tree.root).collect()
    assert [r.status for r in found] == ["UNSIGNED"]


def test_digits_follow_the_files():
    assert [hashtree.digits_for(n) for n in (0, 1, 16 * 1024, 16 * 1024 + 1, 10**9, 10**13)] == [1, 1, 1, 2, 5, 7]
