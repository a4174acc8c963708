"""Joins of transfers to their dimensions.

No broadcast hint is given on clubs or players, which grow with the data: Spark
broadcasts them only below spark.sql.autoBroadcastJoinThreshold, and otherwise
shuffles, where adaptive execution splits the partitions of a club or player that
holds a large share of the rows. The joins run before any grouping and are not
grouped on their own key, so such a split is always open to the planner.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators import filters as flt
from flowspark.operators.filters import TransferFilters


def with_club(transfers: DataFrame, clubs: DataFrame, end: str, *columns: str) -> DataFrame:
    """Join the club of one end ('from' or 'to'); its columns get the end's prefix."""
    key = f"{end}_club_id"
    renamed = {"name": f"{end}_club_name", "country_id": f"{end}_country_id"}
    side = clubs.select(
        F.col("id").alias(key), *[F.col(c).alias(renamed[c]) for c in columns]
    )
    return transfers.join(side, key)


def with_both_clubs(transfers: DataFrame, clubs: DataFrame, *columns: str) -> DataFrame:
    return with_club(with_club(transfers, clubs, "from", *columns), clubs, "to", *columns)


COUNTRY_IDS = ("from_country_id", "to_country_id")


def has_countries(transfers: DataFrame) -> bool:
    return all(c in transfers.columns for c in COUNTRY_IDS)


def with_countries(transfers: DataFrame, clubs: DataFrame) -> DataFrame:
    """Transfers with the country ids of both ends: as stored with them, else those of their clubs.

    Filters on stored ids reach the Parquet scan, and no join is made.
    """
    return transfers if has_countries(transfers) else with_both_clubs(transfers, clubs, "country_id")


def with_player(
    transfers: DataFrame, players: DataFrame, filters: TransferFilters, *columns: str
) -> DataFrame:
    """Join players, keeping only transfers of known players that pass the filters.

    With no player column wanted this is a semi join: no column of players is moved
    beyond the key and what the filters read.
    """
    needed = set(columns)
    if filters.position_groups:
        needed.add("position_group")
    if filters.age_min is not None or filters.age_max is not None:
        needed.add("date_of_birth")
    side = players.select(F.col("id").alias("player_id"), *sorted(needed))
    if not needed:
        return transfers.join(side, "player_id", "left_semi")
    joined = flt.on_player_columns(transfers.join(side, "player_id"), filters)
    return joined.select(*transfers.columns, *columns)


def scoped_clubs(clubs: DataFrame, countries: DataFrame) -> DataFrame:
    """Clubs of in-scope countries."""
    scope = countries.filter("in_scope").select(F.col("id").alias("country_id"))
    return clubs.join(scope, "country_id", "left_semi")


def with_country_names(flows: DataFrame, countries: DataFrame) -> DataFrame:
    """Attach both country names; rows with an unknown country drop out."""
    for end in ("from", "to"):
        names = countries.select(
            F.col("id").alias(f"{end}_country_id"), F.col("name").alias(f"{end}_country_name")
        )
        flows = flows.join(names, f"{end}_country_id")
    return flows
