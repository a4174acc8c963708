"""Fixed schemas of the stored tables. Money is always whole EUR cents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COORDINATE = T.DecimalType(9, 6)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


COUNTRIES = _schema(
    ("id", T.IntegerType()),
    ("name", T.StringType()),
    ("iso_code", T.StringType()),
    ("latitude", _COORDINATE),
    ("longitude", _COORDINATE),
    ("in_scope", T.BooleanType()),
)

LEAGUES = _schema(
    ("id", T.IntegerType()),
    ("name", T.StringType()),
    ("country_id", T.IntegerType()),
    ("tier", T.IntegerType()),
    ("transfermarkt_id", T.StringType()),
)

CLUBS = _schema(
    ("id", T.LongType()),
    ("name", T.StringType()),
    ("country_id", T.IntegerType()),
    ("current_league_id", T.IntegerType()),
    ("transfermarkt_id", T.StringType()),
    ("transfermarkt_url", T.StringType()),
)

PLAYERS = _schema(
    ("id", T.LongType()),
    ("name", T.StringType()),
    ("date_of_birth", T.DateType()),
    ("position", T.StringType()),
    ("position_group", T.StringType()),
    ("nationality", T.StringType()),
    ("transfermarkt_id", T.StringType()),
    ("transfermarkt_url", T.StringType()),
)

# window_key repeats transfer_window as a sortable number, so that a range of
# windows is a comparison that can skip Parquet row groups. The country ids are those of
# the clubs, written when a transfer is stored: a stored club never changes its country.
TRANSFERS = _schema(
    ("id", T.StringType()),
    ("player_id", T.LongType()),
    ("from_club_id", T.LongType()),
    ("to_club_id", T.LongType()),
    ("fee_eur", T.LongType()),
    ("fee_is_loan", T.BooleanType()),
    ("transfer_window", T.StringType()),
    ("window_key", T.IntegerType()),
    ("transfer_date", T.DateType()),
    ("season", T.StringType()),
    ("from_country_id", T.IntegerType()),
    ("to_country_id", T.IntegerType()),
)

PLAYER_VALUATIONS = _schema(
    ("player_id", T.LongType()),
    ("valuation_eur", T.LongType()),
    ("valuation_date", T.DateType()),
)

COUNTRY_TRANSFER_FLOWS = _schema(
    ("from_country_id", T.IntegerType()),
    ("to_country_id", T.IntegerType()),
    ("transfer_window", T.StringType()),
    ("window_key", T.IntegerType()),
    ("total_fee_eur", T.LongType()),
    ("transfer_count", T.LongType()),
    ("loan_count", T.LongType()),
)

CLUB_TRANSFER_SUMMARIES = _schema(
    ("club_id", T.LongType()),
    ("transfer_window", T.StringType()),
    ("window_key", T.IntegerType()),
    ("total_spent_eur", T.LongType()),
    ("total_received_eur", T.LongType()),
    ("players_bought", T.LongType()),
    ("players_sold", T.LongType()),
)

TABLES: dict[str, T.StructType] = {
    "countries": COUNTRIES,
    "leagues": LEAGUES,
    "clubs": CLUBS,
    "players": PLAYERS,
    "transfers": TRANSFERS,
    "player_valuations": PLAYER_VALUATIONS,
    "country_transfer_flows": COUNTRY_TRANSFER_FLOWS,
    "club_transfer_summaries": CLUB_TRANSFER_SUMMARIES,
}

# Every key of a table. The id of a transfer is a hash of its key, so it needs no check.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "countries": [["id"], ["name"], ["iso_code"]],
    "leagues": [["id"], ["transfermarkt_id"]],
    "clubs": [["id"], ["transfermarkt_id"]],
    "players": [["id"], ["transfermarkt_id"]],
    "transfers": [["player_id", "transfer_date", "from_club_id", "to_club_id"]],
    "player_valuations": [["player_id", "valuation_date"]],
    "country_transfer_flows": [["from_country_id", "to_country_id", "transfer_window"]],
    "club_transfer_summaries": [["club_id", "transfer_window"]],
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to their types."""

    def column(field: T.StructField) -> Column:
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
