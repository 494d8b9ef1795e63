"""Exact duplicates by progressive refinement, with built-in functions alone.

One scan groups documents by length and by the hash of a short prefix. Only where
such a group has two rows or more is the whole content hashed, in a second scan; the
texts never move. Which rows those are is told by a bit table of fixed size, so a
scan needs no join on its keys; a row let through in vain costs one hash and is told
apart by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import BLANKS, filter_table, hex_sha256, maybe_in
from bindery.scratch import materialize

PREFIX_CHARS = 64


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: bool = False,
) -> DataFrame:
    """`doc_id, keep_id, group_size, kept`, a row for each row of `docs`.

    Texts are equal when they are so after each run of blanks became one space; null
    counts as empty. `keep_id` is the smallest identifier of the equal texts, nulls
    last; `group_size` counts rows. Rows that repeat an identifier and its text are
    marked alike. Other columns are not read; an empty table gives no rows. `digest`
    adds `text_sha256` of every normalised text, which hashes the others as well.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("body"))
    keyed = texts.select(
        "doc_id",
        "body",
        F.octet_length("body").alias("size"),
        F.xxhash64(F.substring("body", 1, PREFIX_CHARS)).alias("head"),
    )
    shared = keyed.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1")
    table = filter_table(shared.select(F.xxhash64("size", "head").alias("key")), "key")

    rows = keyed.withColumn("key", F.xxhash64("size", "head"))
    rows = maybe_in(rows, "key", table, "survives").select(
        "doc_id",
        F.when(F.col("survives"), hex_sha256(F.col("body"))).alias("full"),
        *([hex_sha256(F.col("body")).alias("text_sha256")] if digest else []),
    )
    rows = materialize(rows, "exact")

    survivors = rows.where("full is not null")
    groups = survivors.groupBy("full").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    extra = ["text_sha256"] if digest else []
    # Written, so that both sides of the join are plain shuffles, which adaptive
    # execution can split where a group of copies is large.
    groups = materialize(groups.where("group_size > 1"), "copies")
    several = survivors.join(groups, "full", "left")
    alone = rows.where("full is null").select(
        "*", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return (
        several.select("doc_id", "keep_id", "group_size", *extra)
        .unionByName(alone.select("doc_id", "keep_id", "group_size", *extra))
        .select(
            "doc_id",
            F.when(F.coalesce("group_size", F.lit(1)) > 1, F.col("keep_id"))
            .otherwise(F.col("doc_id"))
            .alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            *extra,
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )
