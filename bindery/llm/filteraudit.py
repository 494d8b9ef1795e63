"""How filters interact, from decision diagrams of their failures.

What a document does in every order of the filters depends on one thing: the mask of the
filters it fails. One pass counts the documents of each part and mask. From those counts
a part gets a decision diagram: a level for each filter, a branch each for passing and
failing, and at every node the weight (documents, good ones, toxic ones) of what reaches
it. Another order of the filters is another order of the levels, reached by swapping two
neighbouring levels; a swap touches the nodes of those two levels alone. All orders are
visited by one such swap after another. The path on which all filters pass, read from the
root down, gives the steps of an order: at each level the failing branch is what the
filter removes, the passing one what it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import BLANKS
from bindery.scratch import materialize

#: A weight: documents, of them good, of them toxic.
Weight = tuple[int, int, int]
NOTHING: Weight = (0, 0, 0)

STEP = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
STEPS = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEP)


def _sum(a: Weight, b: Weight) -> Weight:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Diagram:
    """A reduced, count-weighted decision diagram of failure masks.

    A node is `(weight, passing, failing)`; a leaf is `(weight,)`. Equal nodes are one
    object, and a subtree that nothing reaches is one node a level, so that the size
    follows the masks that occur, not the 2^filters that could.
    """

    def __init__(self, filters: str, masks: dict[int, Weight]):
        """`masks`: weight by mask, where bit i is set if filter i fails."""
        self.order, self.unique = list(filters), {}
        self.root = self._build(masks, 0)

    def _node(self, *parts):
        return self.unique.setdefault(parts if len(parts) == 1 else (parts[0], *map(id, parts[1:])), parts)

    def _build(self, masks: dict[int, Weight], level: int):
        if level == len(self.order):
            return self._node(masks.get(0, NOTHING))
        halves = ({}, {})
        for mask, weight in masks.items():
            halves[mask & 1][mask >> 1] = weight
        return self._join(*(self._build(half, level + 1) for half in halves))

    def _join(self, passing, failing):
        return self._node(_sum(passing[0], failing[0]), passing, failing)

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next one.

        Nodes above are rebuilt around the changed ones; what lies below is shared.
        """
        done: dict[int, tuple] = {}

        def changed(node, depth):
            found = done.get(id(node))
            if found is None:
                _, passing, failing = node
                if depth < level:
                    found = self._join(changed(passing, depth + 1), changed(failing, depth + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = passing, failing
                    found = self._join(self._join(pp, fp), self._join(pf, ff))
                done[id(node)] = found
            return found

        self.root = changed(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> list[tuple[Weight, Weight]]:
        """What each level keeps and removes along the path on which every filter passes."""
        steps, node = [], self.root
        for _ in self.order:
            _, passing, failing = node
            steps.append((passing[0], failing[0]))
            node = passing
        return steps


def swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after another, so that all n! orders occur, each once.

    The last element runs through the orders of the others: down, and up at the next.
    """
    if n < 2:
        return
    rest = swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1)
        step = next(rest, None)
        if step is None:
            return
        yield step + 1  # the running element is in front
        yield from range(n - 1)
        step = next(rest, None)
        if step is None:
            return
        yield step


def audit(filters: str, masks: dict[int, Weight]) -> list[tuple]:
    """`filter_order, step` and `STEP` for every order of the filters."""
    diagram = Diagram(filters, masks)
    fails, only, shapley = {}, {}, dict.fromkeys(filters, 0)
    for i, name in enumerate(filters):
        fails[name] = sum(w[0] for mask, w in masks.items() if mask >> i & 1)
        only[name] = masks.get(1 << i, NOTHING)[0]
    rows = []

    def read():
        order = "".join(diagram.order)
        for step, (name, (kept, removed)) in enumerate(zip(order, diagram.all_pass()), 1):
            shapley[name] += removed[0]
            rows.append((order, step, name, kept[0], removed, fails[name] - removed[0]))

    read()
    for level in swaps(len(filters)):
        diagram.swap(level)
        read()
    return [
        (order, step, kept, removed[0], redundant, only[name], removed[1], removed[2], shapley[name])
        for order, step, name, kept, removed, redundant in rows
    ]


def filter_steps(counts: DataFrame, filters: str) -> DataFrame:
    """`STEPS` for every part of `counts`: `part, mask, n, good, toxic`.

    `filters` names one letter for each bit of `mask`, the lowest first. A part's masks,
    2^filters at most, come together in one row, whatever its documents; parts are spread
    over tasks. Rows that repeat a part and mask are added up.
    """
    summed = counts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(*(c.to_pylist() for c in batch.columns)):
                weights = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}
                order, step, *columns = zip(*audit(filters, weights))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(order), pa.string()),
                        pa.array(order, pa.string()),
                        pa.array(step, pa.int32()),
                        *(pa.array(c, pa.int64()) for c in columns),
                    ],
                    names=["part", "filter_order", "step", *STEP],
                )

    return parts.mapInArrow(steps, STEPS)


FILTERS = "ABCDE"


def words_of(text: str) -> Column:
    body = F.btrim(F.col(text), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(F.length(body) > 0, F.split(body, BLANKS)).otherwise(F.array())


def content_failures(text: str, words: str) -> list[Column]:
    """Conditions A to D on a text that is never null and its words."""
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        F.col(text).rlike("[#$%&*|]"),
    ]


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    part: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`part, mask, n, good, toxic`: documents by the filters A to E that they fail.

    A: under 200 words; B: fewer distinct words than half; C: over 2% of characters in
    `[A-Z]`; D: any of `#$%&*|`; E: the text of a smaller identifier, table-wide. A null
    text is empty, a null part the empty string. A row with a null identifier neither
    fails E nor makes others fail; rows that repeat an identifier do not make each other
    fail. `labels` (`doc_id, quality, toxic`) may cover some documents; of several rows
    for one identifier any with the value 1 counts. Other columns are not read; an empty
    table gives no rows. Texts, however long, are read once and do not move: what is
    written and shuffled is a digest of 16 bytes.

    Copies are no hot group: texts that are equal fail A to D alike, so E only needs the
    least identifier of each digest, folded before the shuffle, and rows meet it by
    digest and identifier.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        body.alias("text"),
    ).select("*", words_of("text").alias("words"))
    bits = [f.cast("int") * (1 << i) for i, f in enumerate(content_failures("text", "words"))]
    digest = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    rows = texts.select("doc_id", "part", digest.alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = materialize(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "masks")

    known = labels.where("doc_id is not null").groupBy("doc_id")
    known = known.agg(
        *(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic"))
    )
    named, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    least = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = least.withColumn("first", F.lit(0))
    last = 1 << FILTERS.index("E")
    marked = named.join(known, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    found = marked.select(
        "part",
        (F.col("mask") + F.when(F.col("first").isNull(), last).otherwise(0)).alias("mask"),
        "n",
        (F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    ).unionByName(unnamed.select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    return found.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
