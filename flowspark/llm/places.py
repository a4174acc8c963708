"""Places of rows in an order, inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: monotonically_increasing_id: the partition number stands above these bits.
_PARTITION_BITS = 33


def placed(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows plus `name` long: the place of each row in its group, from 0, by order (nulls first).

    Rows are dealt by ranges of (group, order), so a group of any size, or any number of
    equal rows, spreads over tasks. Each task numbers its sorted rows; a window over the row
    counts of (group, task), one row for each task that holds some of a group, says where a
    task's rows start. rows must be the same each time they are read (a kept table).
    """
    keys = [*group, *order, "_tie"]
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = keep(ordered.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_block", F.shiftright("_at", _PARTITION_BITS))
    counts = numbered.groupBy(*group, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    starts = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_block").alias("_b"), shift.alias("_shift"))
    same = F.col("_block") == F.col("_b")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = numbered.join(starts, same).withColumn(name, F.col("_at") + F.col("_shift"))
    return placed.select(*[c for c in rows.columns if c != name], name)
