"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters `[\x20\x09-\x0D]` that part words.
BLANKS = r"[\x20\x09-\x0D]+"

#: Text that one step of a task holds as Python or numpy values at a time.
STEP_BYTES = 8 * 1024 * 1024

#: Bits of a membership table that is broadcast: 65,536 rows of 16 bytes.
FILTER_BITS = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, longer by underscores until no column has that name."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def quoted(names: list[str]) -> list[str]:
    """Names as `select` takes them, whatever signs they hold."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def map_in_arrow(rows: DataFrame, function, schema: T.StructType) -> DataFrame:
    """`rows.mapInArrow` for columns of any name; Spark's own does not take names with dots."""

    def named(n: int) -> list[str]:
        return [f"c{i}" for i in range(n)]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=named(batch.num_columns))

    fields = zip(named(len(schema)), schema.fields)
    inner = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in fields])
    return rows.toDF(*named(len(rows.columns))).mapInArrow(plain, inner).toDF(*schema.names)


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about `limit` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def filter_table(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The long hashes in `key` as set bits, one row for each 64: `slot`, `mask`.

    At most `bits / 64` rows, whatever the number of keys, so that it may be
    broadcast. A key that was put in is always found; others may be found too, so
    an exact step has to follow.
    """
    place = F.pmod(key, F.lit(bits))
    return keys.groupBy(F.shiftright(place, 6).alias("slot")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod({key}, {bits}L) & 63L as int)))").alias("mask")
    )


def maybe_in(rows: DataFrame, key: str, table: DataFrame, flag: str, bits: int = FILTER_BITS):
    """`rows` with `flag`: may the hash in `key` be in the broadcast `filter_table`?"""
    slot, mask = free_name("slot", rows.columns), free_name("mask", rows.columns)
    named = table.select(F.col("slot").alias(slot), F.col("mask").alias(mask))
    place = f"pmod(`{key}`, {bits}L)"
    return (
        rows.withColumn("_slot", F.expr(f"shiftright({place}, 6)"))
        .join(F.broadcast(named), F.col("_slot") == F.col(slot), "left")
        .withColumn(
            flag,
            F.expr(f"coalesce(shiftrightunsigned(`{mask}`, cast({place} & 63L as int)) & 1L, 0L) = 1L"),
        )
        .drop("_slot", slot, mask)
    )


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
