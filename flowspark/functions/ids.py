"""Row ids that need no coordination between tasks."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def transfer_row_id(
    player_id: Column, day: Column, from_club_id: Column, to_club_id: Column
) -> Column:
    """First 16 hex digits of SHA-256 over the natural key."""
    key = F.concat_ws(
        ":",
        player_id.cast("string"),
        F.coalesce(day.cast("string"), F.lit("unknown")),
        from_club_id.cast("string"),
        to_club_id.cast("string"),
    )
    return F.substring(F.sha2(key, 256), 1, 16)
