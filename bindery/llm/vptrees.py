"""Near duplicates: SimHash fingerprints linked through vantage-point trees.

Two fingerprints at most `radius` bits apart have a half with at most `radius // 2`
differing bits, so there is a tree for each half. A node of a tree holds a vantage
point and a distance; halves nearer than it are its inner side, others its outer. A
half is at home in one leaf. As a query it also visits each leaf that the triangle
bound does not rule out: a side is left out only if all of it lies farther than the
half's radius. So every pair meets where one of the two is at home.

The trees are fitted to a bounded sample of the fingerprints, which sets only how
well they split; every fingerprint goes through them. Leaves are the shards: within
one, distances to a vantage point rule out most pairs, and the rest are compared on
the whole fingerprint. A shard sends one link for each member to the least of its
group, never pairs. Equal fingerprints are one from the start. A leaf too full for
one task is cut into blocks: visitors by a hash in one direction, rows at home by
another in the other, so that every visitor still meets every row at home once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.llm.common import free_name, map_in_arrow, quoted
from bindery.llm.components import components
from bindery.scratch import materialize

RADIUS = 3
SHINGLE = 3
#: Fingerprints that a tree is fitted to, and that a leaf should hold at home.
SAMPLE, LEAF = 16_384, 1_024
#: Visitors, and as many rows at home, that one task is to compare.
BLOCK_ROWS = 1 << 17
DEPTH = 24
_BLOCK = 1 << 21


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # blanks and case: ASCII
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    votes, total = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for a in range(0, total, 1 << 16):
        part = words[a : a + (1 << 16) + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE))))
        n = len(part) - SHINGLE + 1
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint as a signed long, a row for each row."""
    place = docs.columns.index(text)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(place)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints.view(np.int64))],
                names=[*batch.schema.names, name],
            )

    return map_in_arrow(docs, mark, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


class Tree:
    """A vantage-point tree over 32-bit halves, as arrays."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.point, self.near, self.inner, self.outer, self.count = [], [], [], [], 0
        random = np.random.default_rng(3)
        least = max(1, len(sample) // max(1, leaves))

        def grow(halves: np.ndarray, depth: int) -> int:
            node = len(self.point)
            for array in (self.point, self.near, self.inner, self.outer):
                array.append(0)
            best = None
            if len(halves) > least and depth < DEPTH:
                for point in random.choice(halves, 4):  # the one that leaves least at the border
                    far = np.bitwise_count(halves ^ point)
                    cut = int(np.median(far))
                    for near in (cut, cut + 1):
                        inside = int((far < near).sum())
                        if 0 < inside < len(halves):
                            border = int((np.abs(far.astype(int) * 2 + 1 - 2 * near) <= 1).sum())
                            worth = abs(2 * inside - len(halves)) + border
                            if best is None or worth < best[0]:
                                best = worth, point, near, far < near
            if best is None:
                self.near[node], self.inner[node] = -1, self.count
                self.count += 1
            else:
                _, self.point[node], self.near[node], inside = best
                self.inner[node] = grow(halves[inside], depth + 1)
                self.outer[node] = grow(halves[~inside], depth + 1)
            return node

        grow(sample, 0)

    def visits(self, halves: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, which halves visit it, whether they are at home) for every leaf visited."""
        waiting = [(0, np.arange(len(halves)), np.ones(len(halves), bool))]
        while waiting:
            node, rows, home = waiting.pop()
            near = self.near[node]
            if near < 0:
                yield self.inner[node], rows, home
                continue
            far = np.bitwise_count(halves[rows] ^ np.uint32(self.point[node])).astype(int)
            go = far - radius < near
            if go.any():
                waiting.append((self.inner[node], rows[go], home[go] & (far[go] < near)))
            go = far + radius >= near
            if go.any():
                waiting.append((self.outer[node], rows[go], home[go] & (far[go] >= near)))


def _half(prints: np.ndarray, tree: int) -> np.ndarray:
    return (prints.view(np.uint64) >> np.uint64(32 * tree)).astype(np.uint32)


def group_shard(
    prints: np.ndarray, query: np.ndarray, home: np.ndarray, tree: int, radius: int
) -> np.ndarray:
    """For each fingerprint the least index of those linked to it, where one row of the
    link is a `query` and the other at `home`."""
    root = np.arange(len(prints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    halves = _half(prints, tree)
    far = np.bitwise_count(halves ^ halves[0])
    at_home = np.flatnonzero(home)
    at_home = at_home[np.argsort(far[at_home], kind="stable")]
    homes_far = far[at_home].astype(int)
    for distance in np.unique(far):
        queries = np.flatnonzero(query & (far == distance))
        a = np.searchsorted(homes_far, int(distance) - radius // 2, "left")
        b = np.searchsorted(homes_far, int(distance) + radius // 2, "right")
        others = at_home[a:b]
        step = max(1, _BLOCK // max(1, len(others)))
        for s in range(0, len(queries), step):
            part = queries[s : s + step]
            close = np.bitwise_count(prints[part][:, None] ^ prints[others][None, :]) <= radius
            q, o = np.nonzero(close)
            q, o = root[part[q]], root[others[o]]
            for pair in np.unique(np.minimum(q, o) * len(prints) + np.maximum(q, o)):
                low, high = find(int(pair) // len(prints)), find(int(pair) % len(prints))
                if low != high:
                    root[max(low, high)] = min(low, high)
            while (root[root] != root).any():
                root = root[root]
    return root


def link_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`a, b`: links whose components are those of all pairs within `radius`.

    `prints` has distinct longs in `fingerprint`.
    """
    spark = prints.sparkSession
    total = prints.count()
    sample = prints.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()
    sample = np.array([r[0] for r in sample], np.int64)
    if not len(sample):
        return spark.createDataFrame([], "a long, b long")
    trees = [Tree(_half(sample, t), max(1, total // LEAF)) for t in (0, 1)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0))
            for t, tree in enumerate(trees):
                for leaf, rows, home in tree.visits(_half(own, t), radius // 2):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, t, np.int32)),
                            pa.array(np.full(n, leaf, np.int32)),
                            pa.array(own[rows]),
                            pa.array(home),
                        ],
                        names=["tree", "leaf", "fingerprint", "home"],
                    )

    def search(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("fingerprint"))
        query, home = (np.asarray(table.column(name)) for name in ("query", "home"))
        links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not home.any() or len(own) < 2:
            return links.empty_table()
        root = group_shard(own, query, home, table.column("tree")[0].as_py(), radius)
        moved = np.flatnonzero(root != np.arange(len(own)))
        return pa.table([pa.array(own[moved]), pa.array(own[root[moved]])], schema=links)

    routed = prints.select("fingerprint").mapInArrow(
        route, "tree int, leaf int, fingerprint long, home boolean"
    )
    blocks = leaf_blocks(materialize(routed, "routed"), BLOCK_ROWS)
    return blocks.groupBy("tree", "leaf", "block").applyInArrow(search, "a long, b long")


def leaf_blocks(routed: DataFrame, most: int) -> DataFrame:
    """`tree, leaf, block, fingerprint, query, home`: `routed` with full leaves in blocks.

    A block is one of about `most` visitors against one of about `most` rows at home.
    There are at most `2 * SAMPLE` leaves, so their counts may be broadcast; leaves
    where nothing is at home go.
    """
    held = routed.groupBy("tree", "leaf").agg(
        F.ceil(F.count("*") / most).alias("tall"), F.ceil(F.count_if("home") / most).alias("wide")
    )
    cut = (
        routed.join(F.broadcast(held.where("wide > 0")), ["tree", "leaf"])
        .withColumn("q", F.expr("pmod(xxhash64(fingerprint, 1), tall)"))
        .withColumn("h", F.expr("pmod(xxhash64(fingerprint, 2), wide)"))
    )
    as_query = "transform(sequence(0L, wide - 1L), c -> q * wide + c)"
    at_home = "transform(sequence(0L, tall - 1L), r -> r * wide + h)"
    places = F.expr(f"if(home, array_union({as_query}, {at_home}), {as_query})")
    return cut.withColumn("block", F.explode(places)).select(
        "tree",
        "leaf",
        "block",
        "fingerprint",
        F.expr("block div wide = q").alias("query"),
        F.expr("home and block % wide = h").alias("home"),
    )


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`doc_id, fingerprint, component_id`, a row for each row of `docs`.

    Texts without words, null ones too, have fingerprint 0 and are linked like any
    other. `component_id` is the smallest identifier reached over links of at most
    `radius` bits, the row's own included; nulls count only if there is no other.
    Repeated rows are linked to each other. Other columns are not read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = with_fingerprints(rows).select("doc_id", "fingerprint")
    rows = materialize(rows, "prints")
    return rows.join(fingerprint_components(rows, radius), "fingerprint", "left").select(
        "doc_id", "fingerprint", "component_id"
    )


def fingerprint_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`fingerprint, root, component_id` from rows of `doc_id, fingerprint`.

    `root` is the group's own, while several groups may have one `component_id` if
    identifiers repeat or are null.
    """
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    prints = materialize(prints, "distinct")
    roots = components(link_fingerprints(prints, radius))
    rooted = prints.join(roots, prints.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "groups")


def keep_first(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: one with the group's smallest identifier, all columns.

    Nulls count only if the group has no other. Of rows that repeat that identifier within
    the group one stays, the first by the number that Spark gives them in a written table.
    """
    mark, row = (free_name(name, docs.columns) for name in ("_print", "_row"))
    marked = with_fingerprints(docs, text, mark).withColumn(row, F.monotonically_increasing_id())
    marked = materialize(marked, "numbered")
    slim = marked.select(
        F.col(doc_id).alias("doc_id"), F.col(mark).alias("fingerprint"), F.col(row).alias("row")
    )
    groups = fingerprint_components(slim.select("doc_id", "fingerprint"), radius)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = slim.groupBy("fingerprint").agg(F.min(first).alias("first"))
    kept_ = firsts.join(groups, "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
    kept_ = kept_.select(F.col("first.row").alias(row))
    return marked.join(kept_, row, "left_semi").select(*quoted(docs.columns))
