"""Raw snapshot rows to typed rows with resolved keys.

Inputs are raw string columns plus an ordinal column that sorts rows in file order
(see sources.snapshot). Rejected rows carry a reject_reason.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions import money, seasons
from flowspark.functions.people import position_group
from flowspark.functions.text import id_text, null_if_missing, parse_date
from flowspark.operators import numbering
from flowspark.sources import seeds
from flowspark.sources.iso_codes import ISO_CODES
from flowspark.sources.snapshot import MALFORMED

REASON = "reject_reason"
UNREAD_DATE = "unread_date"

# Rows ranked by one task where the ordinal is a plain row number.
ROWS_IN_BLOCK = 1 << 16


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _name_or_unknown(raw: Column) -> Column:
    return F.coalesce(null_if_missing(raw), F.lit("Unknown"))


# --- countries and leagues -------------------------------------------------------


def country_name(raw: Column) -> Column:
    """Stored name of a raw country name; missing names stay null."""
    name = null_if_missing(raw)
    return F.coalesce(F.try_element_at(_literal_map(seeds.COUNTRY_ALIASES), name), name)


def competition_countries(competitions: DataFrame, ordinal: str) -> DataFrame:
    """Country name per competition id; the last row of an id counts."""
    return (
        competitions.select("competition_id", country_name(F.col("country_name")).alias("country_name"), ordinal)
        .filter(F.col("country_name").isNotNull())
        .groupBy("competition_id")
        .agg(F.max_by("country_name", ordinal).alias("country_name"))
    )


def override_country(name: Column) -> Column:
    return F.try_element_at(_literal_map(seeds.CLUB_COUNTRY_OVERRIDES), name)


def needed_countries(
    competitions: DataFrame, club_names: DataFrame, ordinal: str
) -> DataFrame:
    """Country names a load refers to, with their order of first appearance.

    Competitions come first, then clubs. `club_names` has (name, country_name, ordinal)
    with the resolved country name of every club row. The block is the part of the
    files, or the run of row numbers, in which a name appears first.
    """
    from_competitions = competitions.select(
        F.lit(0).alias("step"), country_name(F.col("country_name")).alias("name"), ordinal
    )
    from_clubs = club_names.select(F.lit(1).alias("step"), F.col("country_name").alias("name"), ordinal)
    rows = from_competitions.unionByName(from_clubs)
    seen = F.col("first_seen")
    if isinstance(rows.schema[ordinal].dataType, T.StructType):
        place = [seen[ordinal]["file"].alias("file"), seen[ordinal]["block"].alias("block")]
    else:
        place = [F.floor(seen[ordinal] / F.lit(ROWS_IN_BLOCK)).alias("block")]
    return (
        rows.filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min(F.struct("step", ordinal)).alias("first_seen"))
        .withColumn("block", F.struct(seen["step"].alias("step"), *place))
    )


def new_countries(
    spark: SparkSession,
    names: DataFrame,
    countries: DataFrame,
    stage: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows,
) -> DataFrame:
    """Rows for the names (name, first_seen, block) that the country table lacks.

    In order of first appearance they get the next ids, are out of scope and sit at
    (0, 0). Their ISO code is the known one, else the first three letters; a code that
    is stored or was given to an earlier name becomes its first two letters and the
    lowest number whose code is still free.

    Names meet others only through the first two letters of their code. A name whose
    code is taken gets the next number there; a name whose own code is such a number
    (`ZQ1`) either comes before the numbering gets so far, and blocks it, or finds it
    taken. At most nine codes of two letters and a digit need that decision for each
    two letters; all else is counting, split by block, so no two letters own a task.

    Several steps read the coded names and the codes: `stage` writes such a table and
    reads it back; without it they are computed anew.
    """
    iso = spark.createDataFrame(list(ISO_CODES.items()), "name string, iso_code string")
    stored = countries.select("name", F.col("iso_code").alias("base"))
    missing = names.join(stored.select("name"), "name", "left_anti")
    coded = missing.join(F.broadcast(iso), "name", "left").select(
        "name",
        "block",
        F.struct("first_seen", "name").alias("seen"),
        F.coalesce("iso_code", F.upper(F.substring("name", 1, 3))).alias("base"),
    )
    first = coded.groupBy("base").agg(F.min("seen").alias("first_of_base"))
    own_number = F.regexp_extract("base", r"(?s)^..([1-9])$", 1).try_cast("int")
    rows = (
        coded.join(first, "base")
        .join(stored.select("base", F.lit(True).alias("is_stored")), "base", "left")
        .select(
            "name", "block", "seen", "base",
            F.substring("base", 1, 2).alias("prefix"),
            (F.col("is_stored").isNotNull() | (F.col("seen") != F.col("first_of_base"))).alias("taken"),
            own_number.alias("own_number"),
        )
    )
    rows = stage("country_names", rows)
    used = stored.select(
        F.substring("base", 1, 2).alias("prefix"),
        F.regexp_extract("base", r"(?s)^..([1-9][0-9]*)$", 1).try_cast("int").alias("number"),
    ).filter("number is not null").distinct()

    decided = _own_numbers(rows, used)
    lost = decided.filter("not keeps").select("prefix", F.col("number").alias("own_number"), F.lit(True).alias("lost"))
    kept = decided.filter("keeps").select("prefix", "number")
    rows = rows.join(lost, ["prefix", "own_number"], "left").withColumn(
        "renamed", F.col("taken") | F.col("lost").isNotNull()
    )
    ranked = numbering.ordered_rank(rows.filter("renamed"), "rank", ["seen"], "block", ["prefix"])
    codes = rows.filter("not renamed").select("name", "seen", "block", F.col("base").alias("iso_code")).unionByName(
        _free_numbers(ranked, used.unionByName(kept))
    )
    codes = stage("country_codes", codes)
    last_id = countries.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    zero = F.lit(0).cast("decimal(9,6)")
    return numbering.ordered_rank(codes, "rank", ["seen"], "block").select(
        (last_id + F.col("rank")).cast("int").alias("id"),
        "name",
        "iso_code",
        zero.alias("latitude"),
        zero.alias("longitude"),
        F.lit(False).alias("in_scope"),
    )


def _own_numbers(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Which names keep a code that is two letters and a digit.

    The numbering has passed digit d before a name when more renamed names came first
    than there were free numbers below d. Digits are decided from 1 to 9, because a
    name that loses a smaller one is itself renamed.
    """
    contested = rows.filter("own_number is not null and not taken").select(
        "prefix", "own_number", F.col("seen").alias("at")
    )
    before = (
        rows.filter("taken").select("prefix", "seen")
        .join(contested, "prefix")
        .filter(F.col("seen") < F.col("at"))
        .groupBy("prefix", "own_number")
        .agg(F.count("*").alias("before"))
    )
    item = F.struct("own_number", F.coalesce("before", F.lit(0)).alias("before"), "at")
    digits = (
        contested.join(before, ["prefix", "own_number"], "left")
        .groupBy("prefix")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    small = used.filter("number < 10").groupBy("prefix").agg(F.collect_list("number").alias("numbers"))
    digits = digits.join(small, "prefix", "left").withColumn(
        "numbers", F.coalesce("numbers", F.array().cast("array<int>"))
    )

    def with_keeps(x: Column, keeps: Column) -> Column:
        return F.struct(x["own_number"].alias("number"), x["at"].alias("at"), keeps.alias("keeps"))

    def decide(done: Column, x: Column) -> Column:
        renamed = x["before"] + F.size(F.filter(done, lambda d: ~d["keeps"] & (d["at"] < x["at"])))
        held = F.size(F.filter("numbers", lambda n: n < x["own_number"])) + F.size(
            F.filter(done, lambda d: d["keeps"])
        )
        return F.concat(done, F.array(with_keeps(x, renamed < x["own_number"] - held)))

    nothing = F.transform(F.slice("items", 1, 0), lambda x: with_keeps(x, F.lit(False)))
    return digits.select("prefix", F.inline(F.aggregate("items", nothing, decide))).drop("at")


def _free_numbers(ranked: DataFrame, used: DataFrame) -> DataFrame:
    """The rank-th free number of a prefix is its rank plus the used ones it must skip.

    A used number is skipped by every rank above the count of free numbers below it.
    Numbers in a row share that count, so a prefix has few different ones.
    """
    below = F.col("number") - F.row_number().over(Window.partitionBy("prefix").orderBy("number"))
    skips = used.select("prefix", below.alias("free_below")).groupBy("prefix", "free_below").agg(
        F.count("*").alias("skipped")
    )
    runs = skips.groupBy("prefix").agg(F.collect_list(F.struct("free_below", "skipped")).alias("runs"))
    number = F.col("rank") + F.aggregate(
        F.filter("runs", lambda r: r["free_below"] < F.col("rank")),
        F.lit(0).cast("bigint"),
        lambda total, r: total + r["skipped"],
    )
    return ranked.join(runs, "prefix", "left").select(
        "name", "seen", "block",
        F.concat("prefix", F.coalesce(number, F.col("rank")).cast("string")).alias("iso_code"),
    )


def match_leagues(leagues: DataFrame, competitions: DataFrame, ordinal: str) -> DataFrame:
    """Fill a league's missing external id from the first competition of its name."""
    first = (
        competitions.select(null_if_missing(F.col("name")).alias("name"), "competition_id", ordinal)
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min_by("competition_id", ordinal).alias("competition_id"))
    )
    return leagues.join(first, "name", "left").select(
        "id",
        "name",
        "country_id",
        "tier",
        F.coalesce("transfermarkt_id", "competition_id").alias("transfermarkt_id"),
    )


# --- dimensions ------------------------------------------------------------------


def player_rows(raw: DataFrame, ordinal: str) -> DataFrame:
    """Typed player rows; rows without an id drop out."""
    return raw.select(
        id_text(F.col("player_id")).alias("transfermarkt_id"),
        _name_or_unknown(F.col("name")).alias("name"),
        parse_date(F.col("date_of_birth")).alias("date_of_birth"),
        null_if_missing(F.col("sub_position")).alias("position"),
        position_group(null_if_missing(F.col("position"))).alias("position_group"),
        null_if_missing(F.col("country_of_citizenship")).alias("nationality"),
        null_if_missing(F.col("url")).alias("transfermarkt_url"),
        ordinal,
    ).filter(F.col("transfermarkt_id").isNotNull())


def club_rows(raw: DataFrame, competition_country: DataFrame, ordinal: str) -> DataFrame:
    """Typed club rows with the country name each one resolves to.

    An override by club name wins, then the competition's country, then 'Other'.
    """
    typed = raw.select(
        id_text(F.col("club_id")).alias("transfermarkt_id"),
        _name_or_unknown(F.col("name")).alias("name"),
        null_if_missing(F.col("domestic_competition_id")).alias("competition_id"),
        null_if_missing(F.col("url")).alias("transfermarkt_url"),
        ordinal,
    ).filter(F.col("transfermarkt_id").isNotNull())
    by_competition = competition_country.select(
        "competition_id", F.col("country_name").alias("competition_country")
    )
    return typed.join(by_competition, "competition_id", "left").select(
        *typed.columns,
        F.coalesce(
            override_country(F.col("name")), "competition_country", F.lit(seeds.OTHER_COUNTRY)
        ).alias("country_name"),
    )


def club_keys(clubs: DataFrame, countries: DataFrame, leagues: DataFrame) -> DataFrame:
    """Replace country name and competition id by country_id and current_league_id."""
    country = countries.select(F.col("name").alias("country_name"), F.col("id").alias("country_id"))
    league = (
        leagues.filter("transfermarkt_id is not null")
        .groupBy(F.col("transfermarkt_id").alias("competition_id"))
        .agg(F.max("id").alias("current_league_id"))
    )
    return (
        clubs.join(country, "country_name", "left")
        .join(league, "competition_id", "left")
        .drop("country_name", "competition_id")
    )


# --- facts -----------------------------------------------------------------------


def _malformed(raw: DataFrame) -> Column:
    """Whether the reader found the row malformed; rows from elsewhere never are."""
    flag = F.col(MALFORMED) if MALFORMED in raw.columns else F.lit(False)
    return F.coalesce(flag, F.lit(False)).alias(MALFORMED)


def _lookup(rows: DataFrame, dimension: DataFrame, raw_key: str, id_name: str, ordinal: str) -> DataFrame:
    """Left join of an external id to the dimension's id.

    Rows already rejected look for a text that no id has and that differs from row to
    row. Missing ids would otherwise meet under one null key, in one task.
    """
    side = dimension.filter("transfermarkt_id is not null").select(
        F.col("transfermarkt_id").alias("_key"), F.col("id").alias(id_name)
    )
    spread = F.concat(F.lit("!"), F.xxhash64(ordinal).cast("string"))
    key = F.when(F.col(REASON).isNull(), F.col(raw_key)).otherwise(spread)
    return rows.withColumn("_key", key).join(side, "_key", "left").drop("_key")


def transfer_rows(raw: DataFrame, ordinal: str) -> DataFrame:
    """Typed transfer rows, with a reject_reason from what the row itself shows.

    Without a normal season a row is rejected, dated or not, so the window of an
    undated row may rest on the start of the normal season.
    """
    typed = raw.select(
        id_text(F.col("player_id")).alias("raw_player_id"),
        id_text(F.col("from_club_id")).alias("raw_from_club_id"),
        id_text(F.col("to_club_id")).alias("raw_to_club_id"),
        parse_date(F.col("transfer_date")).alias("transfer_date"),
        null_if_missing(F.col("transfer_date")).alias("raw_date"),
        "transfer_season",
        "transfer_fee",
        _malformed(raw),
        ordinal,
    ).withColumn(UNREAD_DATE, F.col("raw_date").isNotNull() & F.col("transfer_date").isNull())
    typed = seasons.with_season(money.with_fee(typed, "transfer_fee"), "transfer_season")
    typed = typed.withColumn(
        "transfer_window", seasons.window_label(F.col("transfer_date"), F.col("season_start"))
    )
    reason = (
        F.when(F.col(MALFORMED), "malformed_row")
        .when(F.col("fee_excluded"), "excluded_fee")
        .when(F.col("raw_player_id").isNull(), "missing_player")
        .when(F.col("raw_from_club_id").isNull() | F.col("raw_to_club_id").isNull(), "missing_club")
        .when(F.col("transfer_window").isNull() | F.col("season").isNull(), "no_window_or_season")
    )
    return typed.withColumn(REASON, reason).drop(
        "transfer_fee", "transfer_season", "fee_excluded", "season_start", "raw_date", MALFORMED
    )


def resolve_transfers(
    typed: DataFrame, players: DataFrame, clubs: DataFrame, ordinal: str
) -> DataFrame:
    """Look up the three ids; a miss rejects a row that had no reason yet."""
    rows = _lookup(typed, players, "raw_player_id", "player_id", ordinal)
    rows = _lookup(rows, clubs, "raw_from_club_id", "from_club_id", ordinal)
    rows = _lookup(rows, clubs, "raw_to_club_id", "to_club_id", ordinal)
    miss = F.when(F.col("player_id").isNull(), "unknown_player").when(
        F.col("from_club_id").isNull() | F.col("to_club_id").isNull(), "unknown_club"
    )
    return rows.withColumn(REASON, F.coalesce(REASON, miss))


def valuation_rows(raw: DataFrame, ordinal: str) -> DataFrame:
    """Typed valuation rows with a reject_reason from what the row itself shows."""
    typed = raw.select(
        id_text(F.col("player_id")).alias("raw_player_id"),
        money.value_cents(F.col("market_value_in_eur")).alias("valuation_eur"),
        parse_date(F.col("date")).alias("valuation_date"),
        null_if_missing(F.col("date")).alias("raw_date"),
        _malformed(raw),
        ordinal,
    )
    reason = (
        F.when(F.col(MALFORMED), "malformed_row")
        .when(F.col("raw_player_id").isNull(), "missing_player")
        .when(F.col("valuation_eur").isNull(), "missing_value")
        .when(F.col("raw_date").isNull(), "missing_date")
        .when(F.col("valuation_date").isNull(), "unread_date")
    )
    return typed.withColumn(REASON, reason).drop("raw_date", MALFORMED)


def resolve_valuations(typed: DataFrame, players: DataFrame, ordinal: str) -> DataFrame:
    rows = _lookup(typed, players, "raw_player_id", "player_id", ordinal)
    miss = F.when(F.col("player_id").isNull(), "unknown_player")
    return rows.withColumn(REASON, F.coalesce(REASON, miss))


def accepted(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col(REASON).isNull()).drop(REASON, UNREAD_DATE)


#: Every outcome of a resolved row, in the order that reasons are given.
TRANSFER_OUTCOMES = (
    "malformed_row", "excluded_fee", "missing_player", "missing_club", "no_window_or_season",
    "unknown_player", "unknown_club", "accepted_unread_date", "accepted",
)
VALUATION_OUTCOMES = (
    "malformed_row", "missing_player", "missing_value", "missing_date", "unread_date", "unknown_player", "accepted",
)


def outcome(columns: list[str]) -> Column:
    """The reject reason of a resolved row, or 'accepted'.

    A transfer whose date text states no date is accepted as undated, under its own name.
    """
    if UNREAD_DATE in columns:
        unread = F.when(F.col(UNREAD_DATE), "accepted_unread_date")
        return F.coalesce(REASON, unread, F.lit("accepted"))
    return F.coalesce(REASON, F.lit("accepted"))


def outcome_metrics(columns: list[str], outcomes: tuple[str, ...]) -> list[Column]:
    """Row counts by outcome as aggregates, to be observed while the rows are written."""
    name = outcome(columns)
    return [F.count("*").alias("rows"), *[F.count_if(name == o).alias(o) for o in outcomes]]


def outcome_counts(resolved: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return resolved.groupBy(outcome(resolved.columns).alias("outcome")).agg(F.count("*").alias("row_count"))
