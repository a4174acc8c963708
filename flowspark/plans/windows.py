"""Available transfer windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.seasons import window_key


def available_windows(transfers: DataFrame, order: str = "label") -> DataFrame:
    """Distinct windows with their sort key, in order."""
    return (
        transfers.select("transfer_window")
        .distinct()
        .withColumn("sort_key", window_key(F.col("transfer_window"), order))
        .orderBy("sort_key", "transfer_window")
    )
