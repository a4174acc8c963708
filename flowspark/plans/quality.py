"""Data-quality checks as a table of results.

Every check yields (name, severity, passed, message, details). The figures behind
the checks are one-row aggregates; the transfers are read once for all their figures, and
once more to list odd windows.
"""

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.aggregates import permanent_fee
from flowspark.plans.tables import Tables


@dataclass(frozen=True)
class Limits:
    """Bands and thresholds of the checks."""

    players: tuple[int, int] = (10_000, 500_000)
    clubs: tuple[int, int] = (100, 5_000)
    transfers: tuple[int, int] = (5_000, 500_000)
    player_valuations: tuple[int, int] = (50_000, 5_000_000)
    future_days: int = 180
    outlier_fee_eur: int = 500_000_000
    distinct_fees: int = 10
    bad_windows_listed: int = 10
    bad_groups_listed: int = 100


DEFAULT_LIMITS = Limits()

# The form of a window label and the known position groups.
WINDOW_FORM = r"^(Summer|Winter) [0-9]{4}$"
POSITION_GROUPS = ["GK", "DEF", "MID", "FWD"]


# --- figures ---------------------------------------------------------------------


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def transfer_figures(transfers: DataFrame, players: DataFrame, as_of: date, limits: Limits) -> DataFrame:
    """All figures of the transfers, from one scan.

    Rows are grouped three ways at once, by window, by player and by fee. The sums are those
    of the windows, put together; the fees' groups are counted, and the players' groups look
    for their player. Each grouping combines before the shuffle, so no key owns a task.
    """
    fee, loan, window = F.col("fee_eur"), F.col("fee_is_loan"), F.col("transfer_window")
    horizon = F.date_add(F.lit(as_of), limits.future_days)
    keys = [F.col(c) for c in ("_window", "_player", "_fee")]
    rows = transfers.withColumns({"_window": window, "_player": F.col("player_id"), "_fee": fee})
    grouped = rows.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_way"),
        F.count("*").alias("_n"),
        F.count_if(fee < 0).alias("negative_fees"),
        F.count_if(fee > limits.outlier_fee_eur * 100).alias("outlier_fees"),
        F.count_if(F.col("transfer_date") > horizon).alias("future_dates"),
        F.sum(permanent_fee()).alias("raw_fee"),
        F.count_if(~loan).alias("raw_permanent"),
        F.count_if(loan).alias("raw_loan"),
    )
    known = players.select(F.col("id").alias("_player"), F.lit(True).alias("_known"))
    joined = grouped.join(known, "_player", "left")
    by_window, by_player, by_fee = (F.col("_way") == way for way in (0b011, 0b101, 0b110))
    well_formed = F.coalesce("_window", F.lit("")).rlike(WINDOW_FORM)

    def total(name: str) -> Column:
        return _zero(F.sum(F.when(by_window, F.col(name))))

    sums = ("negative_fees", "outlier_fees", "future_dates", "raw_fee", "raw_permanent", "raw_loan")
    return joined.agg(
        total("_n").alias("transfers"),
        *[total(name).alias(name) for name in sums],
        F.count_if(by_fee & F.col("_fee").isNotNull()).alias("distinct_fees"),
        F.count_if(by_window).alias("windows"),
        F.count_if(by_window & ~well_formed).alias("bad_windows"),
        _zero(F.sum(F.when(by_player & F.col("_known").isNull(), F.col("_n")))).alias("orphan_transfers"),
    )


def valuation_figures(valuations: DataFrame, players: DataFrame) -> DataFrame:
    """Rows and rows without their player, from one scan."""
    per_player = valuations.groupBy("player_id").agg(F.count("*").alias("_n"))
    known = players.select(F.col("id").alias("player_id"), F.lit(True).alias("_known"))
    return per_player.join(known, "player_id", "left").agg(
        _zero(F.sum("_n")).alias("player_valuations"),
        _zero(F.sum(F.when(F.col("_known").isNull(), F.col("_n")))).alias("orphan_valuations"),
    )


def flow_figures(flows: DataFrame) -> DataFrame:
    return flows.agg(
        _zero(F.sum("total_fee_eur")).alias("agg_fee"),
        _zero(F.sum("transfer_count")).alias("agg_permanent"),
        _zero(F.sum("loan_count")).alias("agg_loan"),
    )


def orphans(facts: DataFrame, players: DataFrame) -> DataFrame:
    """Rows per player id that no player has.

    Facts are counted per player before the join, so a player with most of the rows
    is one row in it.
    """
    per_player = facts.groupBy("player_id").agg(F.count("*").alias("row_count"))
    known = players.select(F.col("id").alias("player_id"))
    return per_player.join(known, "player_id", "left_anti")


def bad_windows(transfers: DataFrame) -> DataFrame:
    """Distinct window labels not of the form 'Summer 2023' (a null is bad too)."""
    well_formed = F.coalesce("transfer_window", F.lit("")).rlike(WINDOW_FORM)
    return transfers.select("transfer_window").distinct().filter(~well_formed)


def _listed(values: DataFrame, column: str, most: int, name: str) -> DataFrame:
    """The first values of a column, in order, as one text."""
    first = values.orderBy(column).limit(most)
    listed = F.sort_array(F.collect_list(F.coalesce(column, F.lit("null"))))
    return first.agg(F.array_join(listed, ", ").alias(name))


def _player_figures(players: DataFrame, limits: Limits) -> DataFrame:
    """Player count and unexpected position groups, the first of them listed."""
    group = F.col("position_group")
    per_group = players.groupBy(group).agg(F.count("*").alias("n"))
    unexpected = ~group.isin(POSITION_GROUPS)
    counts = per_group.agg(_zero(F.sum("n")).alias("players"), F.count_if(unexpected).alias("bad_groups"))
    listed = _listed(per_group.filter(unexpected), "position_group", limits.bad_groups_listed, "bad_group_list")
    return _one_row([counts, listed])


def _count_figure(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def _one_row(figures: list[DataFrame]) -> DataFrame:
    """Several one-row results side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), figures)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


# --- results ---------------------------------------------------------------------


def _text(c: Column | str) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _details(*columns: str) -> Column:
    pairs = [x for c in columns for x in (F.lit(c), F.coalesce(_text(c), F.lit("")))]
    return F.create_map(*pairs)


def _result(name: str, severity: Column | str, passed: Column, good: Column, bad: Column, details: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        passed.alias("passed"),
        F.when(passed, good).otherwise(bad).alias("message"),
        details.alias("details"),
    )


def _zero_check(name: str, severity: str, figure: str, good: str, bad: str) -> Column:
    return _result(
        name,
        severity,
        F.col(figure) == 0,
        F.lit(good),
        F.concat(_text(figure), F.lit(f" {bad}")),
        F.create_map(F.lit("count"), _text(figure)),
    )


def _row_count_check(table: str, band: tuple[int, int]) -> Column:
    low, high = band
    return _result(
        f"row_count_{table}",
        "warning",
        F.col(table).between(low, high),
        F.concat(F.lit(f"{table}: "), _text(table), F.lit(" rows")),
        F.concat(F.lit(f"{table}: "), _text(table), F.lit(f" rows, expected {low} to {high}")),
        F.create_map(
            F.lit("count"), _text(table),
            F.lit("expected_min"), F.lit(str(low)),
            F.lit("expected_max"), F.lit(str(high)),
        ),
    )


def _row_count_checks(limits: Limits) -> list[Column]:
    bands = {
        "players": limits.players,
        "clubs": limits.clubs,
        "transfers": limits.transfers,
        "player_valuations": limits.player_valuations,
    }
    return [_row_count_check(table, band) for table, band in bands.items()]


def _distribution_check(limits: Limits) -> Column:
    empty = F.col("transfers") == 0
    return _result(
        "fee_distribution_not_degenerate",
        "warning",
        empty | (F.col("distinct_fees") >= limits.distinct_fees),
        F.when(empty, F.lit("No transfers to check")).otherwise(
            F.concat(_text("distinct_fees"), F.lit(" distinct fees"))
        ),
        F.concat(F.lit("Only "), _text("distinct_fees"), F.lit(" distinct fees")),
        _details("distinct_fees", "transfers"),
    )


_RECONCILED = ("fee", "permanent", "loan")


def _reconciliation_check() -> Column:
    not_built = (F.col("agg_permanent") == 0) & (F.col("raw_permanent") > 0)
    equal = reduce(
        lambda a, b: a & b, [F.col(f"agg_{m}") == F.col(f"raw_{m}") for m in _RECONCILED]
    )
    difference = F.concat_ws(
        "; ",
        *[
            F.concat(F.lit(f"{m}: stored "), _text(f"agg_{m}"), F.lit(", transfers "), _text(f"raw_{m}"))
            for m in _RECONCILED
        ],
    )
    return _result(
        "country_flow_reconciliation",
        F.when(not_built, F.lit("info")).otherwise(F.lit("warning")),
        not_built | equal,
        F.when(not_built, F.lit("Flow aggregate is empty, not compared")).otherwise(
            F.lit("Flow aggregate equals the transfers")
        ),
        difference,
        _details(*[f"{side}_{m}" for m in _RECONCILED for side in ("agg", "raw")]),
    )


def _listing_check(name: str, figure: str, listing: str, good: str, bad: str) -> Column:
    return _result(
        name,
        "warning",
        F.col(figure) == 0,
        F.lit(good),
        F.concat(_text(figure), F.lit(f" {bad}: "), F.col(listing)),
        F.create_map(F.lit("bad_values"), F.coalesce(F.col(listing), F.lit(""))),
    )


def _results(figures: DataFrame, checks: list[Column]) -> DataFrame:
    return figures.select(F.inline(F.array(*checks)))


def row_counts(tables: Tables, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    names = ("players", "clubs", "transfers", "player_valuations")
    figures = _one_row([_count_figure(getattr(tables, n), n) for n in names])
    return _results(figures, _row_count_checks(limits))


def reconciliation(tables: Tables) -> DataFrame:
    """Stored country flows against the transfers: fee, permanent and loan counts."""
    loan = F.col("fee_is_loan")
    raw = tables.transfers.agg(
        _zero(F.sum(permanent_fee())).alias("raw_fee"),
        F.count_if(~loan).alias("raw_permanent"),
        F.count_if(loan).alias("raw_loan"),
    )
    flows = tables.with_aggregates().country_transfer_flows
    return _results(_one_row([raw, flow_figures(flows)]), [_reconciliation_check()])


def quality_report(tables: Tables, as_of: date, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """All 13 results."""
    flows = tables.with_aggregates().country_transfer_flows
    figures = _one_row(
        [
            transfer_figures(tables.transfers, tables.players, as_of, limits),
            flow_figures(flows),
            _listed(bad_windows(tables.transfers), "transfer_window", limits.bad_windows_listed, "bad_window_list"),
            _player_figures(tables.players, limits),
            _count_figure(tables.clubs, "clubs"),
            valuation_figures(tables.player_valuations, tables.players),
        ]
    )
    checks = [
        *_row_count_checks(limits),
        _zero_check("no_negative_fees", "error", "negative_fees",
                    "No negative fee", "transfers with a negative fee"),
        _zero_check("no_orphan_transfers", "error", "orphan_transfers",
                    "Every transfer has its player", "transfers without their player"),
        _zero_check("no_orphan_valuations", "error", "orphan_valuations",
                    "Every valuation has its player", "valuations without their player"),
        _zero_check("no_far_future_transfers", "warning", "future_dates",
                    "No transfer far in the future", f"transfers over {limits.future_days} days ahead"),
        _zero_check("no_outlier_fees", "warning", "outlier_fees",
                    "No outlier fee", f"transfers above EUR {limits.outlier_fee_eur}"),
        _distribution_check(limits),
        _reconciliation_check(),
        _listing_check("transfer_window_format", "bad_windows", "bad_window_list",
                       "All windows well formed", "windows of another form"),
        _listing_check("position_groups_valid", "bad_groups", "bad_group_list",
                       "All position groups known", "unknown position groups"),
    ]
    return _results(figures, checks)


def summary(report: DataFrame) -> DataFrame:
    """Failed errors, failed warnings, passed and total."""
    failed = ~F.col("passed")
    return report.agg(
        F.count_if(failed & (F.col("severity") == "error")).alias("errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
        F.count_if("passed").alias("passed"),
        F.count("*").alias("total"),
    )
