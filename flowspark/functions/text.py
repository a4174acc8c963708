"""Text cleaning shared by all raw columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field texts that count as missing in a raw snapshot.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

WHITESPACE = " \t\n\r\u000b\u000c\u00a0"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def null_if_missing(text: Column) -> Column:
    """A missing-value token becomes null; any other text is kept as it is."""
    return F.when(~text.isin(NULL_TOKENS), text)


# Whole part of a plain number without leading zeros, and numbers with an exponent.
_WHOLE_PART = r"^[\s+]*0*(-?[0-9]+)(?:\.[0-9]*)?\s*$"
_WITH_EXPONENT = r"^\s*[+-]?[0-9.]+[eE][+-]?[0-9]+\s*$"


def id_text(text: Column) -> Column:
    """A numeric id as whole-number text: '100.0' and '100' are both '100'.

    The digits are taken as text, so long ids keep all of them. Missing-value tokens
    and other text match no number and are null. One short expression: three of them
    must fit a generated method that the JVM still compiles.
    """
    whole = F.regexp_extract(text, _WHOLE_PART, 1)
    exponent = text.try_cast("double").try_cast("bigint").cast("string")
    return F.when(whole != "", whole).when(text.rlike(_WITH_EXPONENT), exponent)


_TIME = r"(?:[ T]+[0-9]{1,2}:[0-9]{2}.*)?$"
_YEAR_FIRST = r"^\s*([0-9]{4})[/.]?([0-9]{1,2})[/.]?([0-9]{1,2})" + _TIME
_YEAR_LAST = r"^\s*([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})" + _TIME
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_MONTH_FIRST = rf"(?i)^\s*{_MONTH}[ .-]+([0-9]{{1,2}})(?:st|nd|rd|th)?[ ,-]+([0-9]{{4}})" + _TIME
_DAY_FIRST = rf"(?i)^\s*([0-9]{{1,2}})(?:st|nd|rd|th)?[ .-]*{_MONTH}[ .,-]*([0-9]{{4}})" + _TIME
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def parse_date(text: Column) -> Column:
    """The date a text states, with or without a time of day; null if it states none.

    ISO dates, `2023/7/1` and `20230701`, `7/31/2023` (month first; day first where the
    first number can be no month), `Jul 1, 2023` and `1 July 2023`. The parts are put
    together as an ISO date, so no date format is tried in vain.
    """

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def iso(year: Column, month: Column, day: Column) -> Column:
        padded = [F.lpad(p, 2, "0") for p in (month, day)]
        return F.concat_ws("-", year, *padded).try_cast("date")

    def named(pattern: str, group: int) -> Column:
        place = F.position(F.lower(F.substring(part(pattern, group), 1, 3)), F.lit(_MONTHS))
        return F.floor((place + 2) / 3).cast("string")

    first, second = part(_YEAR_LAST, 1), part(_YEAR_LAST, 2)
    day_first = first.try_cast("int") > 12
    other = (
        F.when(
            text.rlike(_YEAR_LAST),
            iso(
                part(_YEAR_LAST, 3),
                F.when(day_first, second).otherwise(first),
                F.when(day_first, first).otherwise(second),
            ),
        )
        .when(text.rlike(_YEAR_FIRST), iso(*[part(_YEAR_FIRST, g) for g in (1, 2, 3)]))
        .when(text.rlike(_MONTH_FIRST), iso(part(_MONTH_FIRST, 3), named(_MONTH_FIRST, 1), part(_MONTH_FIRST, 2)))
        .when(text.rlike(_DAY_FIRST), iso(part(_DAY_FIRST, 3), named(_DAY_FIRST, 2), part(_DAY_FIRST, 1)))
    )
    return F.coalesce(text.try_cast("date"), other)
