"""Fee and value text to EUR cents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.text import WHITESPACE, null_if_missing, strip

# An amount is a run of digits, dots and commas with an optional unit.
AMOUNT = r"[0-9.,]+[\s\u00a0]*(?:m|k|th)?"
UNIT_FACTORS = {"m": 1_000_000.0, "k": 1_000.0, "h": 1_000.0}

# A failed cast is slow, so number text is checked before it is cast.
_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
_UNIT_LETTERS = "mkth"


def cents(euros: Column) -> Column:
    """Euros (double) to cents, truncated towards zero; null when out of range."""
    return (euros * F.lit(100.0)).try_cast("bigint")


def value_cents(raw: Column) -> Column:
    """Plain euro text such as '60000000.0' in cents."""
    return cents(strip(null_if_missing(raw)).try_cast("double"))


def with_fee(df: DataFrame, raw: str) -> DataFrame:
    """Add fee_eur, fee_is_loan and fee_excluded from a fee text column.

    A null fee is undisclosed. Excluded rows are the return leg of a loan. The steps
    are separate projections so that every pattern is matched once per row; as one
    nested expression they would be repeated in each branch that uses them.
    """
    low, amount, number = F.col("_low"), F.col("_amount"), F.col("_number")

    # The unit is told by the last letter of the amount; no unit ends in a digit.
    factor = F.lit(1.0)
    for letter, value in UNIT_FACTORS.items():
        factor = F.when(F.endswith(amount, F.lit(letter)), F.lit(value)).otherwise(factor)
    digits = F.translate(number, ".,", "")
    is_decimal = (digits != "") & (F.length(number) - F.length(digits) <= 1)
    priced = F.when(is_decimal, F.translate(number, ",", ".").cast("double") * factor)
    plain = F.translate(low, ",", "")

    returning, loan = F.col("fee_excluded"), F.col("_loan")
    fee = (
        F.when(low.isNull() | returning, F.lit(None).cast("bigint"))
        .when(loan & low.contains("loan fee") & (number != ""), F.col("_cents"))
        .when(loan | low.contains("free transfer") | (low == "free"), F.lit(0).cast("bigint"))
        .when(low.isin("", "-", "?"), F.lit(None).cast("bigint"))
        .when(F.col("_cents").isNotNull(), F.col("_cents"))
        .when(plain.rlike(_PLAIN_NUMBER), cents(plain.cast("double")))
    )
    return (
        df.withColumn("_low", F.lower(strip(null_if_missing(F.col(raw)))))
        .withColumns(
            {
                "_amount": F.regexp_extract("_low", AMOUNT, 0),
                "_loan": F.coalesce(low.contains("loan"), F.lit(False)),
                "fee_excluded": F.coalesce(low.contains("end of loan"), F.lit(False)),
            }
        )
        .withColumn("_number", F.translate(amount, _UNIT_LETTERS + WHITESPACE, ""))
        .withColumn("_cents", cents(priced))
        .withColumns({"fee_eur": fee, "fee_is_loan": loan & ~returning})
        .drop("_low", "_amount", "_loan", "_number", "_cents")
    )
