"""Connected components of links between long numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links` (`a`, `b`) but the roots: the least of its component.

    Alternating stars: every node hands its larger neighbours to its least one, then its
    smaller ones and itself, until nothing moves. Rounds grow with the logarithm of the
    longest path. Links are folded to minima before they are shuffled, and each round is
    a written table.
    """

    def stars(edges: DataFrame) -> DataFrame:  # up > low
        both = edges.union(edges.select("low", "up"))
        least = both.groupBy("up").agg(F.min("low").alias("least"))
        least = least.select("up", F.least("up", "least").alias("least"))
        large = both.join(least, "up").where("low > up").select(
            F.col("low").alias("up"), F.col("least").alias("low")
        )
        large = large.distinct()
        least = large.groupBy("up").agg(F.min("low").alias("least"))
        small = large.join(least, "up").where("low != least").select(
            F.col("low").alias("up"), F.col("least").alias("low")
        )
        return small.union(least.select("up", F.col("least").alias("low"))).distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("up", "low"))).first()

    edges = links.where("a != b").select(
        F.greatest("a", "b").alias("up"), F.least("a", "b").alias("low")
    )
    edges = materialize(edges.distinct(), "links")
    before = state(edges)
    while before[0]:
        edges = materialize(stars(edges), "links")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("up").alias("node"), F.col("low").alias("root"))
