"""Player attributes: position groups and ages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.text import strip

# Broad position to position group.
POSITION_GROUPS = {
    "goalkeeper": "GK",
    "defender": "DEF",
    "midfield": "MID",
    "attack": "FWD",
}


def position_group(broad: Column) -> Column:
    pairs = [F.lit(x) for pair in POSITION_GROUPS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(broad)))


def _completed_years(start: Column, end: Column) -> Column:
    before_birthday = (F.month(end) * 100 + F.dayofmonth(end)) < (
        F.month(start) * 100 + F.dayofmonth(start)
    )
    return F.year(end) - F.year(start) - before_birthday.cast("int")


def age_at(day: Column, born: Column) -> Column:
    """Completed calendar years; a day before birth counts backwards from zero."""
    return F.when(day >= born, _completed_years(born, day)).otherwise(
        -_completed_years(day, born)
    )


def current_age(born: Column, as_of: Column) -> Column:
    """Whole years of 365.25 days, the rule of the player profile."""
    return F.floor(F.datediff(as_of, born) / F.lit(365.25)).cast("int")
