"""Seasons and transfer windows.

A window is the label of a market period, 'Summer 2023' or 'Winter 2024'.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Season and window patterns.
SEASON = r"^[\s\u00a0]*([0-9]{2,4}[/-][0-9]{2,4})"
SEASON_START = r"^[\s\u00a0]*([0-9]{2,4})[/-]"
WINDOW = r"^(?:Summer|Winter)\s+([0-9]{4})"
LAST_WINDOW_KEY = 9999 * 2 + 1


def _full_year(digits: Column) -> Column:
    """Two-digit years below 80 are 20xx, the rest 19xx; others are taken as they are."""
    number = F.when(digits != "", digits).cast("int")
    century = F.when(digits < "80", F.lit(2000)).otherwise(F.lit(1900))
    return number + F.when(F.length(digits) == 2, century).otherwise(F.lit(0))


def season_label(first: Column, last: Column) -> Column:
    return F.concat(first.cast("string"), F.lit("-"), last.cast("string"))


def _years(matched: Column) -> tuple[Column, Column]:
    """Both years of 'first/last' or 'first-last'; null for an empty match."""
    text = F.translate(matched, "-", "/")
    return (
        _full_year(F.substring_index(text, "/", 1)),
        _full_year(F.substring_index(text, "/", -1)),
    )


def normalize_season(raw: Column) -> Column:
    """'23/24', '2023/2024' and '23-24' all become '2023-2024'; else null."""
    return season_label(*_years(F.regexp_extract(raw, SEASON, 1)))


def season_start_year(raw: Column) -> Column:
    return _full_year(F.regexp_extract(raw, SEASON_START, 1))


def window_label(day: Column, start_year: Column) -> Column:
    """June to December is summer, January to May winter; undated rows use the season.

    A season that starts in year 0 gives no window.
    """
    half = F.when(F.month(day) >= 6, F.lit("Summer ")).otherwise(F.lit("Winter "))
    return F.when(day.isNotNull(), F.concat(half, F.year(day).cast("string"))).when(
        start_year != 0, F.concat(F.lit("Summer "), start_year.cast("string"))
    )


def derive_window(day: Column, season: Column) -> Column:
    return window_label(day, season_start_year(season))


def with_season(df: DataFrame, raw: str) -> DataFrame:
    """Add season and season_start from a season text column, matching it once."""
    first, last = _years(F.col("_matched"))
    return (
        df.withColumn("_matched", F.regexp_extract(raw, SEASON, 1))
        .withColumns({"season_start": first, "_end": last})
        .withColumn("season", season_label(F.col("season_start"), F.col("_end")))
        .drop("_matched", "_end")
    )


def window_key(window: Column, order: str = "label") -> Column:
    """Sortable number of a window label; labels of another form sort first (0).

    order='label' puts Winter Y after Summer Y, the default everywhere.
    order='calendar' puts it before, since its months come first in the year.
    """
    if order not in ("label", "calendar"):
        raise ValueError(f"unknown window order: {order!r}")
    later = "Winter" if order == "label" else "Summer"
    # One match per row: a label that matches starts with its half of the year.
    digits = F.regexp_extract(window, WINDOW, 1)
    year = F.when(digits != "", digits).cast("int")
    return F.coalesce(year * 2 + window.startswith(later).cast("int"), F.lit(0))


def dated_window_key(day: Column) -> Column:
    """The window_key of a dated move, told by its date alone; -1 without a date."""
    return F.coalesce(F.year(day) * 2 + (F.month(day) < 6).cast("int"), F.lit(-1))


def event_year(day: Column, season: Column) -> Column:
    """Year text of a dated event, else the first part of its season."""
    return F.coalesce(F.year(day).cast("string"), F.split(season, "-")[0])
