"""Dense ids for new dimension rows, and ranks in an order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _RANK, _OFFSET = "_bucket", "_rank", "_offset"


def dense_ids(
    rows: DataFrame, key: str, after: Column, name: str = "id", buckets: int = 4096
) -> DataFrame:
    """Number rows with a unique text key from `after` + 1, without gaps.

    Rows are spread over hash buckets and ranked inside each; a bucket starts where
    the ones before it end. Only the `buckets` counts are ever ordered in one task,
    and the numbers depend on the keys alone, so a lost task yields the same ones.
    """
    spread = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)))
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(_BUCKET)
        .agg(F.count("*").alias("_n"))
        .select(_BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_OFFSET))
    )
    inside = Window.partitionBy(_BUCKET).orderBy(key)
    numbered = spread.withColumn(_RANK, F.row_number().over(inside))
    # At most `buckets` offset rows, so the broadcast is bounded.
    return (
        numbered.join(F.broadcast(offsets), _BUCKET)
        .withColumn(name, after + F.col(_OFFSET) + F.col(_RANK))
        .drop(_BUCKET, _OFFSET, _RANK)
    )


def ordered_rank(
    rows: DataFrame, name: str, order: list[str], block: str, group: list[str] | None = None
) -> DataFrame:
    """Add the place of each row in an order, from 1, for all rows or within groups.

    `block` rises with the order and bounds how many rows one task sorts: rows are
    ranked inside their block, and a block starts where those before it end. Only the
    row counts of the blocks are ordered as a whole.
    """
    group = group or []
    before = (
        Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*group, block)
        .agg(F.count("*").alias("_n"))
        .select(*group, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_OFFSET))
    )
    inside = Window.partitionBy(*group, block).orderBy(*order)
    return (
        rows.withColumn(_RANK, F.row_number().over(inside))
        .join(offsets, [*group, block])
        .withColumn(name, F.col(_OFFSET) + F.col(_RANK))
        .drop(_OFFSET, _RANK)
    )
