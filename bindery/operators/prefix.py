"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.scratch import materialize


def as_of(sorted_values: str, value: str) -> Column:
    """Place of the last entry of a sorted array column that is not above `value`, by
    halving; -1 where there is none. A null value counts as 0."""
    middle = "cast((a.low + a.high) div 2 as int)"
    return F.expr(
        f"""aggregate(
          sequence(0, cast(ceil(log2(size({sorted_values}) + 1)) as int)),
          named_struct('low', 0, 'high', size({sorted_values})),
          (a, step) -> if(a.low >= a.high, a,
            if({sorted_values}[{middle}] <= coalesce({value}, 0),
              named_struct('low', {middle} + 1, 'high', a.high),
              named_struct('low', a.low, 'high', {middle}))),
          a -> a.low - 1)"""
    )


def running_total(
    df: DataFrame, groups: list[str], order: str, value: Column, out: str
) -> DataFrame:
    """Add `out`, the inclusive running sum of `value` by `order` in each group,
    and `<out>_before`, the same without the row itself. A null value counts as 0.

    A single window over a hot group would be one task. Rows are dealt by ranges of
    (group, order) instead and summed within each range; only the totals, one for each
    group and range, go through the per-group window. So it sees as many rows of a group
    as there are partitions, whatever the gaps between order values. The dealt rows are
    written, so that a recomputed task finds the same ranges: give few columns.
    """
    dealt = (
        df.withColumn(order, F.coalesce(F.col(order), F.lit(0)))
        .withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
        .repartitionByRange(*groups, order)
        .withColumn("_part", F.spark_partition_id())
    )
    rows = materialize(dealt, "ordered")
    totals = rows.groupBy(*groups, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part")
    earlier = F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *(F.col(g).alias(f"_of_{g}") for g in groups),
        F.col("_part").alias("_of_part"),
        F.coalesce(earlier, F.lit(0)).alias("_offset"),
    )
    same = F.col("_part") == F.col("_of_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    inside = Window.partitionBy(*groups, "_part").orderBy(order)
    partial = F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_partial", partial)
        .join(offsets, same)
        .withColumn(out, F.col("_partial") + F.col("_offset"))
        .withColumn(f"{out}_before", F.col(out) - F.col("_value"))
        .drop("_part", "_value", "_partial", *offsets.columns)
    )


def stacked(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add `out`, the sum of `value` over all rows of smaller `key`, which is unique.

    Rows are dealt by ranges of the key and written; one window sees the ranges' sums,
    as many as there are partitions.
    """
    dealt = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    rows = materialize(dealt, "stacked")
    unbounded = (Window.unboundedPreceding, -1)
    before = F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(*unbounded))
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(*unbounded)
    earlier = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        rows.withColumn("_earlier", earlier)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_earlier") + F.col("_offset"))
        .select(*df.columns, out)
    )
