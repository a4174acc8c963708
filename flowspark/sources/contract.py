"""Column contracts of the raw CSV files, checked before any row is read."""

import logging

logger = logging.getLogger(__name__)

# Columns each file must have.
REQUIRED_COLUMNS = {
    "competitions.csv": {"competition_id", "name", "country_name"},
    "players.csv": {
        "player_id", "name", "date_of_birth", "position", "sub_position",
        "country_of_citizenship", "url",
    },
    "clubs.csv": {"club_id", "name", "domestic_competition_id", "url"},
    "transfers.csv": {
        "player_id", "transfer_date", "transfer_season", "from_club_id",
        "to_club_id", "transfer_fee",
    },
    "player_valuations.csv": {"player_id", "date", "market_value_in_eur"},
}

# Files of facts: a row that cannot be read is rejected and counted, the rest is loaded.
FACT_FILES = {"transfers.csv", "player_valuations.csv"}

# Further columns each file may have without a warning.
OPTIONAL_COLUMNS = {
    "competitions.csv": {
        "competition_code", "sub_type", "type", "country_id", "domestic_league_code",
        "confederation", "total_clubs", "url",
    },
    "players.csv": {
        "first_name", "last_name", "last_season", "current_club_id", "player_code",
        "country_of_birth", "city_of_birth", "foot", "height_in_cm",
        "contract_expiration_date", "agent_name", "image_url", "international_caps",
        "international_goals", "current_national_team_id",
        "current_club_domestic_competition_id", "current_club_name",
        "market_value_in_eur", "highest_market_value_in_eur",
    },
    "clubs.csv": {
        "club_code", "total_market_value", "squad_size", "average_age",
        "foreigners_number", "foreigners_percentage", "national_team_players",
        "stadium_name", "stadium_seats", "net_transfer_record", "coach_name",
        "last_season", "filename",
    },
    "transfers.csv": {
        "from_club_name", "to_club_name", "market_value_in_eur", "player_name",
    },
    "player_valuations.csv": {
        "current_club_name", "current_club_id", "player_club_domestic_competition_id",
    },
}


class SchemaValidationError(RuntimeError):
    """A raw file lacks a column that the load needs."""


def check_columns(file_name: str, columns: list[str]) -> None:
    """Raise on missing required columns, warn on unknown ones.

    A file without a contract passes.
    """
    required = REQUIRED_COLUMNS.get(file_name)
    if required is None:
        return
    present = set(columns)
    missing = sorted(required - present)
    if missing:
        raise SchemaValidationError(f"{file_name}: missing required columns {missing}")
    unknown = sorted(present - required - OPTIONAL_COLUMNS[file_name])
    if unknown:
        logger.warning("%s: unknown columns, not used: %s", file_name, unknown)
