"""Country list and country detail."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators import aggregates
from flowspark.operators import filters as flt
from flowspark.operators import lookups
from flowspark.operators.filters import ALL, TransferFilters
from flowspark.plans.tables import Tables

# Length of the top lists and the default page.
TOP_CLUBS = 5
PAGE_SIZE = 20

SORT_COLUMNS = {"fee": "fee_eur", "date": "transfer_date", "player_name": "player_name"}


def countries_in_scope(tables: Tables) -> DataFrame:
    return (
        tables.countries.filter("in_scope")
        .select("id", "name", "iso_code", "latitude", "longitude")
        .orderBy("name")
    )


def _scoped(tables: Tables, country_id: int) -> DataFrame:
    return tables.countries.filter((F.col("id") == country_id) & F.col("in_scope"))


def club_totals(
    tables: Tables,
    country_id: int,
    filters: TransferFilters = ALL,
    counterpart_id: int | None = None,
) -> DataFrame:
    """Spent, received, bought and sold per club of a country.

    Only the window range of the filters counts here. Against any country the stored
    club summaries answer, with loans in the counts; against one counterpart the
    transfers do, without loans.
    """
    clubs = tables.clubs.filter(F.col("country_id") == country_id)
    home = clubs.select(F.col("id").alias("club_id"), F.col("name").alias("club_name"))
    if counterpart_id is None:
        summaries = flt.in_window_range(tables.with_aggregates().club_transfer_summaries, filters)
    else:
        summaries = _pair_summaries(tables, country_id, counterpart_id, filters)
    totals = (
        summaries.join(home.select("club_id"), "club_id", "left_semi")
        .groupBy("club_id")
        .agg(*aggregates.sums(aggregates.CLUB_MEASURES))
    )
    return totals.join(home, "club_id").filter(_scoped(tables, country_id).exists())


def _pair_summaries(
    tables: Tables, country_id: int, counterpart_id: int, filters: TransferFilters
) -> DataFrame:
    """Club summaries of the permanent transfers between two countries."""
    transfers = flt.in_window_range(tables.transfers, filters).filter(~F.col("fee_is_loan"))
    ends = tables.clubs.filter(F.col("country_id").isin(country_id, counterpart_id))
    between = lookups.with_countries(transfers, ends)
    pair = between.filter(flt.direction_of(country_id, counterpart_id))
    buys = (F.col("to_country_id") == country_id) & (F.col("from_country_id") == counterpart_id)
    sells = (F.col("from_country_id") == country_id) & (F.col("to_country_id") == counterpart_id)
    fee, zero = F.coalesce("fee_eur", F.lit(0)), F.lit(0).cast("bigint")
    names = ("club_id", "counts", *aggregates.CLUB_MEASURES)
    one, none = F.lit(1), F.lit(0)
    legs = aggregates.both_sides(
        pair,
        dict(zip(names, (F.col("to_club_id"), buys, fee, zero, one, none))),
        dict(zip(names, (F.col("from_club_id"), sells, zero, fee, none, one))),
    )
    return legs.filter("counts").drop("counts")


def _top(totals: DataFrame, money: str, count: str) -> DataFrame:
    return (
        totals.orderBy(F.col(money).desc(), "club_id")
        .limit(TOP_CLUBS)
        .select(
            "club_id",
            "club_name",
            "total_spent_eur",
            "total_received_eur",
            F.col(count).alias("transfer_count"),
        )
    )


def top_buyers(totals: DataFrame) -> DataFrame:
    return _top(totals, "total_spent_eur", "players_bought")


def top_sellers(totals: DataFrame) -> DataFrame:
    return _top(totals, "total_received_eur", "players_sold")


def top_lists(totals: DataFrame) -> DataFrame:
    """Both top lists from one evaluation of the totals, told apart by `list`.

    Spark applies the rank limit before the shuffle too, so each task passes on at most
    one list length of rows per list.
    """

    def entry(name: str, money: str, count: str) -> Column:
        return F.struct(
            F.lit(name).alias("list"),
            "club_id",
            "club_name",
            "total_spent_eur",
            "total_received_eur",
            F.col(count).alias("transfer_count"),
            F.col(money).alias("_ranked"),
        )

    entries = totals.select(
        F.inline(
            F.array(
                entry("buyers", "total_spent_eur", "players_bought"),
                entry("sellers", "total_received_eur", "players_sold"),
            )
        )
    )
    best = Window.partitionBy("list").orderBy(F.col("_ranked").desc(), "club_id")
    ranked = entries.withColumn("_rank", F.row_number().over(best))
    return ranked.filter(F.col("_rank") <= TOP_CLUBS).drop("_ranked", "_rank")


def _sum_of(list_name: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("list") == list_name, F.col(column))), F.lit(0))


def country_header(tables: Tables, country_id: int, totals: DataFrame) -> DataFrame:
    """The country with two net spends: over its top lists, and over all its clubs."""
    top = top_lists(totals).agg(
        _sum_of("buyers", "total_spent_eur") - _sum_of("sellers", "total_received_eur")
    )
    net = totals.agg(
        F.coalesce(F.sum(F.col("total_spent_eur") - F.col("total_received_eur")), F.lit(0))
    )
    return _scoped(tables, country_id).select(
        "id", "name", "iso_code", top.scalar().alias("net_spend_top5"), net.scalar().alias("net_spend")
    )


def country_pair_totals(totals: DataFrame) -> DataFrame:
    """Panel totals of a country pair: sums over the two top lists, and the net flow."""
    sums = top_lists(totals).agg(
        _sum_of("buyers", "total_spent_eur").alias("total_spent_eur"),
        _sum_of("buyers", "transfer_count").alias("buy_count"),
        _sum_of("sellers", "total_received_eur").alias("total_received_eur"),
        _sum_of("sellers", "transfer_count").alias("sell_count"),
    )
    spent, received = F.col("total_spent_eur"), F.col("total_received_eur")
    return sums.select(
        "*",
        F.abs(spent - received).alias("net_flow_eur"),
        (spent > received).alias("flows_to_counterpart"),
    )


def country_transfers(
    tables: Tables,
    country_id: int,
    filters: TransferFilters = ALL,
    counterpart_id: int | None = None,
    direction: str | None = None,
) -> DataFrame:
    """All transfers of a country's clubs that pass the filters (not the country list)."""
    transfers = flt.on_transfer_columns(tables.transfers, filters)
    placed = lookups.with_countries(transfers, tables.clubs)
    chosen = placed.filter(flt.direction_of(country_id, counterpart_id, direction))
    # Names only join what is left; the joins of all transfers carry ids alone.
    named = lookups.with_both_clubs(chosen, tables.clubs, "name")
    players = tables.players.select(
        "id",
        F.col("name").alias("player_name"),
        F.col("transfermarkt_url").alias("player_transfermarkt_url"),
        "position_group",
        "date_of_birth",
    )
    rows = lookups.with_player(
        named, players, filters, "player_name", "player_transfermarkt_url", "position_group"
    )
    return rows.filter(_scoped(tables, country_id).exists()).select(
        F.col("id").alias("transfer_id"),
        "player_id",
        "player_name",
        "player_transfermarkt_url",
        "from_club_name",
        "from_club_id",
        "to_club_name",
        "to_club_id",
        "fee_eur",
        "fee_is_loan",
        "position_group",
        "transfer_window",
        "transfer_date",
    )


def page_of(
    rows: DataFrame,
    sort_by: str = "fee",
    sort_order: str = "desc",
    page: int = 1,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """One page of transfers; unknown values sort last either way, ties by id."""
    column = F.col(SORT_COLUMNS.get(sort_by, "fee_eur"))
    ordered = column.asc_nulls_last() if sort_order == "asc" else column.desc_nulls_last()
    return rows.orderBy(ordered, "transfer_id").offset((page - 1) * page_size).limit(page_size)


def total_of(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


@dataclass(frozen=True)
class CountryDetail:
    header: DataFrame
    top_buying_clubs: DataFrame
    top_selling_clubs: DataFrame
    transfers: DataFrame
    total: DataFrame


def country_detail(
    tables: Tables,
    country_id: int,
    filters: TransferFilters = ALL,
    sort_by: str = "fee",
    sort_order: str = "desc",
    page: int = 1,
    page_size: int = PAGE_SIZE,
    counterpart_id: int | None = None,
    direction: str | None = None,
) -> CountryDetail:
    """All parts of the detail view; every part is empty for a country out of scope."""
    totals = club_totals(tables, country_id, filters, counterpart_id)
    rows = country_transfers(tables, country_id, filters, counterpart_id, direction)
    return CountryDetail(
        header=country_header(tables, country_id, totals),
        top_buying_clubs=top_buyers(totals),
        top_selling_clubs=top_sellers(totals),
        transfers=page_of(rows, sort_by, sort_order, page, page_size),
        total=total_of(rows),
    )
