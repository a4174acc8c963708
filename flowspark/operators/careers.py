"""Career stints of all players at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.seasons import event_year

PRESENT = "Present"


def _when_order() -> Column:
    """Dated transfers by date, undated ones after them, ties by id."""
    return F.struct(
        F.col("transfer_date").isNull().alias("undated"),
        F.col("transfer_date").alias("day"),
        F.col("id").alias("id"),
    )


#: A year of one player is spread over this many groups.
SALTS = 64


def _segmented(transfers: DataFrame) -> DataFrame:
    """Transfers with the segment of their player's history that they fall into, and a salt."""
    dated = F.col("transfer_date").isNotNull()
    year = F.lpad(F.year("transfer_date").cast("string"), 4, "0")
    return transfers.select(
        "player_id",
        "id",
        "from_club_id",
        "to_club_id",
        "transfer_date",
        "fee_eur",
        "fee_is_loan",
        event_year(F.col("transfer_date"), F.col("season")).alias("start_year"),
        F.when(dated, F.concat(F.lit("0"), year)).otherwise(F.concat(F.lit("1"), F.substring("id", 1, 3))).alias("segment"),
        F.when(dated, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).alias("salt"),
    )


def career_stints(transfers: DataFrame, clubs: DataFrame) -> DataFrame:
    """One row per stay at a club: who came in, from which year, until which year.

    A stay ends in the year of the player's next transfer, or at 'Present'. The
    first transfer also opens the stay at the club it left, with no start year.

    Nothing orders all transfers of one player. They fall into segments that follow
    each other in time: one per year for dated transfers, one per leading three
    id characters for undated ones. Inside a dated segment every next year is the
    segment's own year; only the last transfer of a segment looks beyond it, to the
    head of the next segment. Each segment therefore carries its first and last transfer
    and what lies beyond, and rows meet that by player, segment and salt.

    The transfers are dealt once, by those three. Both the groups and the rows read
    that one shuffle: the groups' heads hold all its columns, so that Spark sees
    the same shuffle and plans it, and the scan below it, once (a filter of only one side
    would make them two, hence the one before the shuffle). A player's year is
    spread by the salt; no window runs over more than one salted group, one undated
    segment, or the segments of one player.
    """
    group = ["player_id", "segment", "salt"]
    rows = _segmented(transfers).filter("player_id is not null and segment is not null and salt is not null").repartition(*group)
    groups = rows.groupBy(*group).agg(
        F.min_by(F.struct(*[c for c in rows.columns if c not in group]), _when_order()).alias("head"),
        F.min(_when_order()).alias("first"),
        F.max(_when_order()).alias("last"),
    )
    # What a segment's groups know together, and then what the next segment begins with.
    whole = Window.partitionBy("player_id", "segment")
    along = Window.partitionBy("player_id").orderBy("segment", "salt")
    known = groups.select(
        *group,
        F.min_by(F.col("head")["start_year"], F.col("first")).over(whole).alias("head_year"),
        F.min("first").over(whole)["id"].alias("first_id"),
        F.max("last").over(whole)["id"].alias("last_id"),
    )
    next_head = F.when(F.lead("segment").over(along) != F.col("segment"), F.lead("head_year").over(along))
    stepped = known.withColumns({"next_head": next_head, "opens": F.first("segment").over(along) == F.col("segment")})
    carried = stepped.select(
        *group,
        "last_id",
        F.coalesce(F.max("next_head").over(whole), F.lit(PRESENT)).alias("beyond"),
        F.when(F.col("opens"), F.col("first_id")).alias("opening_id"),
    )

    inside = F.lead("start_year").over(Window.partitionBy(*group).orderBy("id"))
    inside = F.when(F.col("transfer_date").isNotNull(), F.col("start_year")).otherwise(inside)
    placed = rows.withColumn("inside", inside).join(carried, group)
    end_year = F.when(F.col("id") == F.col("last_id"), F.col("beyond")).otherwise(F.col("inside"))
    opens = F.col("id") == F.col("opening_id")

    def stay(opening: bool, club: str, start: Column, end: Column, fee: Column, loan: Column) -> Column:
        return F.struct(
            F.lit(opening).alias("is_opening"), F.col(club).alias("club_id"), start.alias("start_year"),
            end.alias("end_year"), fee.alias("fee_eur"), loan.alias("fee_is_loan"),
        )

    arrival = stay(False, "to_club_id", F.col("start_year"), end_year, F.col("fee_eur"), F.col("fee_is_loan"))
    opening = stay(
        True, "from_club_id", F.lit(None).cast("string"), F.col("start_year"), F.lit(None).cast("bigint"), F.lit(False)
    )
    both = F.when(opens, F.array(arrival, opening)).otherwise(F.array(arrival))
    stays = placed.select("player_id", F.col("id").alias("transfer_id"), "transfer_date", F.inline(both))
    names = clubs.select(F.col("id").alias("club_id"), F.col("name").alias("club_name"))
    return stays.join(names, "club_id")
