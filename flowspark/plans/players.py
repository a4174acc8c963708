"""Player search, player detail and per-player series."""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.people import current_age
from flowspark.operators import careers, lookups
from flowspark.plans.tables import Tables


def search_players(tables: Tables, text: str, limit: int = 10) -> DataFrame:
    """Players whose name contains the text in any case; % and _ are wildcards."""
    return (
        tables.players.filter(F.col("name").ilike(f"%{text}%"))
        .select(
            F.col("id").alias("player_id"),
            F.col("name").alias("player_name"),
            "position",
            "position_group",
            "nationality",
        )
        .orderBy("player_name", "player_id")
        .limit(limit)
    )


def player_profile(tables: Tables, player_id: int, as_of: date) -> DataFrame:
    return tables.players.filter(F.col("id") == player_id).select(
        F.col("id").alias("player_id"),
        "name",
        "date_of_birth",
        current_age(F.col("date_of_birth"), F.lit(as_of)).alias("age"),
        "position",
        "position_group",
        "nationality",
        "transfermarkt_url",
    )


def player_history(tables: Tables, player_id: int) -> DataFrame:
    """Transfers of one player, undated ones last."""
    own = tables.transfers.filter(F.col("player_id") == player_id)
    return (
        lookups.with_both_clubs(own, tables.clubs, "name")
        .select(
            F.col("id").alias("transfer_id"),
            "from_club_id",
            "from_club_name",
            "to_club_id",
            "to_club_name",
            "fee_eur",
            "fee_is_loan",
            "transfer_date",
            "transfer_window",
            "season",
        )
        .orderBy(F.col("transfer_date").asc_nulls_last(), "transfer_id")
    )


def player_valuations(tables: Tables, player_id: int) -> DataFrame:
    return (
        tables.player_valuations.filter(F.col("player_id") == player_id)
        .select("valuation_date", "valuation_eur")
        .orderBy("valuation_date")
    )


@dataclass(frozen=True)
class PlayerDetail:
    profile: DataFrame
    transfers: DataFrame
    valuations: DataFrame


def player_detail(tables: Tables, player_id: int, as_of: date) -> PlayerDetail:
    return PlayerDetail(
        player_profile(tables, player_id, as_of),
        player_history(tables, player_id),
        player_valuations(tables, player_id),
    )


def career_stints(tables: Tables) -> DataFrame:
    return careers.career_stints(tables.transfers, tables.clubs)


def value_series(tables: Tables, player_id: int | None = None) -> DataFrame:
    """Valuations and permanent fees above 0 as one dated series, in cents.

    For one player the points come in date order; for all players they are keyed rows.
    """
    valuations = tables.player_valuations.select(
        "player_id",
        F.col("valuation_date").alias("point_date"),
        F.lit("valuation").alias("kind"),
        F.col("valuation_eur").alias("amount_eur"),
        F.lit(None).cast("string").alias("transfer_id"),
    )
    fees = tables.transfers.filter(
        F.col("transfer_date").isNotNull() & (F.col("fee_eur") > 0) & ~F.col("fee_is_loan")
    ).select(
        "player_id",
        F.col("transfer_date").alias("point_date"),
        F.lit("fee").alias("kind"),
        F.col("fee_eur").alias("amount_eur"),
        F.col("id").alias("transfer_id"),
    )
    series = valuations.unionByName(fees)
    if player_id is None:
        return series
    return series.filter(F.col("player_id") == player_id).orderBy("point_date", "kind", "transfer_id")
