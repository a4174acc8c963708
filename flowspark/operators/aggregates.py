"""Flow and club aggregates.

All are sums and counts, so Spark combines them before the shuffle and a hot key
costs one row per task, not one task.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.seasons import window_key
from flowspark.operators.lookups import COUNTRY_IDS, has_countries, with_countries

FLOW_MEASURES = ("total_fee_eur", "transfer_count", "loan_count")
FLOW_COUNTS = ("transfer_count", "loan_count")
CLUB_MEASURES = ("total_spent_eur", "total_received_eur", "players_bought", "players_sold")
CLUB_COUNTS = ("players_bought", "players_sold")
#: What a signed transfer adds.
SIGNED = ("moves", "permanent_fee_eur", "permanent", "loans")


def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _permanent(fee: Column, loan: Column) -> Column:
    return F.when(~loan, _zero_if_null(fee)).otherwise(0)


def permanent_fee() -> Column:
    """Fee of a permanent move; 0 for loans and unknown fees."""
    return _permanent(F.col("fee_eur"), F.col("fee_is_loan"))


def flow_measures() -> list[Column]:
    loan = F.col("fee_is_loan")
    return [
        F.sum(permanent_fee()).alias("total_fee_eur"),
        F.count_if(~loan).alias("transfer_count"),
        F.count_if(loan).alias("loan_count"),
    ]


def sums(names: tuple[str, ...]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def window_columns(transfers: DataFrame) -> list[str]:
    """The window label, with its sort key where the transfers have one."""
    return [c for c in ("transfer_window", "window_key") if c in transfers.columns]


def _end_columns(transfers: DataFrame) -> tuple[str, ...]:
    """What tells the countries of a transfer: its stored country ids, else its clubs."""
    return COUNTRY_IDS if has_countries(transfers) else ("from_club_id", "to_club_id")


def country_flows_by_window(transfers: DataFrame, clubs: DataFrame) -> DataFrame:
    """Fee sum, permanent count and loan count per country pair and window."""
    window = window_columns(transfers)
    rows = transfers.select(*_end_columns(transfers), *window, "fee_eur", "fee_is_loan")
    return (
        with_countries(rows, clubs)
        .groupBy("from_country_id", "to_country_id", *window)
        .agg(*flow_measures())
    )


def country_flows_from_transfers(transfers: DataFrame, clubs: DataFrame) -> DataFrame:
    """The same over all windows, for filtered transfers."""
    rows = transfers.select(*_end_columns(transfers), "fee_eur", "fee_is_loan")
    return (
        with_countries(rows, clubs)
        .groupBy("from_country_id", "to_country_id")
        .agg(*flow_measures())
    )


def sum_flows(flows: DataFrame) -> DataFrame:
    """Stored flows summed over their windows."""
    return flows.groupBy("from_country_id", "to_country_id").agg(*sums(FLOW_MEASURES))


def both_sides(df: DataFrame, buyer: dict[str, Column], seller: dict[str, Column]) -> DataFrame:
    """One row for the buying end and one for the selling end, from a single scan."""
    sides = [F.struct(*[c.alias(n) for n, c in side.items()]) for side in (buyer, seller)]
    return df.select(F.inline(F.array(*sides)))


def club_summaries_by_window(transfers: DataFrame) -> DataFrame:
    """Spent, received, bought and sold per club and window.

    Money leaves loans out; the counts keep them.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1)
    fee, window = permanent_fee(), window_columns(transfers)
    when = [F.col(c) for c in window]
    names = ("club_id", *window, *CLUB_MEASURES)
    legs = both_sides(
        transfers,
        dict(zip(names, (F.col("to_club_id"), *when, fee, zero, one, F.lit(0)))),
        dict(zip(names, (F.col("from_club_id"), *when, zero, fee, F.lit(0), one))),
    )
    return legs.groupBy("club_id", *window).agg(*sums(CLUB_MEASURES))


# --- kept by change --------------------------------------------------------------


def signed_changes(changes: DataFrame) -> DataFrame:
    """Inserted and updated transfers as what they add: new values count 1, replaced ones -1.

    `changes` has the key and the new values of each transfer, and in _old the values that an
    update replaced. An update within its window is one row, the difference; what adds
    nothing is left out. Rows have the ends, the window, and in SIGNED the number of
    transfers, their permanent fees, and how many are permanent and loans.
    """
    ends = ["from_club_id", "to_club_id"]
    ends += COUNTRY_IDS if has_countries(changes) else ()

    def measures(value: Callable[[str], Column]) -> list[Column]:
        fee, loan = value("fee_eur"), value("fee_is_loan")
        kinds = [F.when(kind, 1).otherwise(0).cast("bigint") for kind in (~loan, loan)]
        return [F.lit(1).cast("bigint"), _permanent(fee, loan), *kinds]

    def row(window: Column, values: list[Column]) -> Column:
        return F.struct(window.alias("transfer_window"), *[v.alias(n) for n, v in zip(SIGNED, values, strict=True)])

    new, old = measures(F.col), measures(lambda v: F.col(f"_old.{v}"))
    window, before = F.col("transfer_window"), F.col("_old.transfer_window")
    added, taken = row(window, new), row(before, [-o for o in old])
    net = row(window, [n - o for n, o in zip(new, old, strict=True)])
    steps = F.when(before.isNull(), F.array(added)).when(before == window, F.array(net)).otherwise(F.array(added, taken))
    signed = changes.select(*ends, F.inline(steps)).filter(" or ".join(f"{n} <> 0" for n in SIGNED))
    return signed.withColumn("window_key", window_key(F.col("transfer_window")))


def flow_deltas(signed: DataFrame, clubs: DataFrame) -> DataFrame:
    """What signed transfers add to the flows of their country pairs and windows."""
    return (
        with_countries(signed, clubs)
        .groupBy("from_country_id", "to_country_id", "transfer_window", "window_key")
        .agg(
            F.sum("permanent_fee_eur").alias("total_fee_eur"),
            F.sum("permanent").alias("transfer_count"),
            F.sum("loans").alias("loan_count"),
        )
    )


def club_deltas(signed: DataFrame) -> DataFrame:
    """What signed transfers add to the summaries of their clubs and windows."""
    zero, moves, fee = F.lit(0).cast("bigint"), F.col("moves"), F.col("permanent_fee_eur")
    when = [F.col("transfer_window"), F.col("window_key")]
    names = ("club_id", "transfer_window", "window_key", *CLUB_MEASURES)
    legs = both_sides(
        signed,
        dict(zip(names, (F.col("to_club_id"), *when, fee, zero, moves, zero))),
        dict(zip(names, (F.col("from_club_id"), *when, zero, fee, zero, moves))),
    )
    return legs.groupBy("club_id", "transfer_window", "window_key").agg(*sums(CLUB_MEASURES))


def with_deltas(stored: DataFrame, deltas: DataFrame, measures: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
    """Stored sums plus deltas. A group that no transfer is left in goes; a rebuild would not have it."""
    key = [c for c in stored.columns if c not in measures]
    merged = stored.select(*key, *measures).unionByName(deltas.select(*key, *measures)).groupBy(*key).agg(*sums(measures))
    left = F.lit(0)
    for c in counts:
        left = left + F.col(c)
    return merged.filter(left > 0)


def net_spend(flows: DataFrame) -> DataFrame:
    """Spent, received and net per country, from country flows.

    A domestic flow adds to both sides.
    """
    zero, fee = F.lit(0).cast("bigint"), F.col("total_fee_eur")
    names = ("country_id", "total_spent_eur", "total_received_eur")
    legs = both_sides(
        flows,
        dict(zip(names, (F.col("to_country_id"), fee, zero))),
        dict(zip(names, (F.col("from_country_id"), zero, fee))),
    )
    return (
        legs.groupBy("country_id")
        .agg(*sums(("total_spent_eur", "total_received_eur")))
        .withColumn("net_spend_eur", F.col("total_spent_eur") - F.col("total_received_eur"))
    )


def node_totals(flows: DataFrame) -> DataFrame:
    """Fee volume and transfer count per country over both ends, and its net spend.

    A domestic flow counts twice, and cancels out in the net spend.
    """
    fee, count = F.col("total_fee_eur"), F.col("transfer_count")
    names = ("country_id", "volume", "transfer_count", "net_spend_eur")
    legs = both_sides(
        flows,
        dict(zip(names, (F.col("to_country_id"), fee, count, fee))),
        dict(zip(names, (F.col("from_country_id"), fee, count, -fee))),
    )
    return legs.groupBy("country_id").agg(*sums(names[1:]))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts."""
    return df.groupBy(*key).agg(F.count("*").alias("row_count")).filter("row_count > 1")
