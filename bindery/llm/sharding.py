"""Shards that each hold the mixture of sources, with built-in functions alone.

Proportional stratified interleaving: rows are shuffled by a seeded hash within each
source and ranked; sorted by fractional rank, every stretch of the whole order holds
each source in proportion, and equal cuts give the shards. Law `rows`: the counts of
any two shards differ by one at most. A source begins at a hashed phase between two
ranks, so that sources of few rows, however many, spread over all shards and cells.

Ranks never come from one task: hash and fractional rank are cut into cells of about
`CELL_ROWS` rows, rows are numbered within a cell, and the cells' counts are summed.
Only identifiers, sizes and checksums are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.scratch import materialize

CELL_ROWS = 20_000


def _numbered(rows: DataFrame, cell: list[str], order: list[str], into: list[str]) -> DataFrame:
    """Add `number`, from 0, in `order` within `into` (all rows if empty); `cell` refines `into`.

    `into` ordered by the last of `cell` must be ordered by `order`.
    """
    counts = rows.groupBy(*cell).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*into).orderBy(cell[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return (
        rows.withColumn("_place", place)
        .join(counts.drop("_rows"), cell)
        .withColumn("number", F.col("_before") + F.col("_place") - 1)
        .drop("_place", "_before")
    )


def stratified_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """`doc_id, source, size, text_crc32, shard, slot`, a row for each row of `docs`.

    `size` is the text's UTF-8 bytes and one (a null text: one), `slot` counts from 0
    in the shard without gaps. Null is a source of its own, a null identifier is
    shuffled like any other, and rows that repeat an identifier take neighbouring
    places. Other columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        ),
        "shards",
    )
    total = rows.count()
    cells = max(1, math.ceil(total / CELL_ROWS))
    last = ["doc_id", "text_crc32", "size"]
    rows = rows.select(
        "*",
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("key"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), *last), 11).alias("shuffled"),
    ).withColumn("cell", F.expr(f"cast(shuffled / {2.0**53!r}D * {cells} as long)"))
    ranked = _numbered(rows, ["key", "cell"], ["shuffled", *last], ["key"]).drop("cell")

    held = rows.groupBy("key").agg(F.count("*").alias("held"))
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 11) * F.lit(2.0**-53)
    ranked = ranked.join(held, "key").withColumn(
        "fraction", (F.col("number") + phase) / F.col("held")
    )
    ranked = ranked.drop("number").withColumn(
        "cell", F.expr(f"cast(fraction * {cells} as long)")
    )
    placed = _numbered(ranked, ["cell"], ["fraction", "key", *last], [])
    n = max(1, total)
    return placed.withColumn("shard", F.expr(f"cast(number * {shards}L div {n}L as int)")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        "shard",
        F.expr(f"number - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"),
    )
