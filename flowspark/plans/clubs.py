"""Club search and the one-hop club network."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators import aggregates
from flowspark.operators import filters as flt
from flowspark.operators import lookups
from flowspark.operators.filters import ALL, TransferFilters
from flowspark.plans.countries import PAGE_SIZE
from flowspark.plans.tables import Tables

EDGE_MEASURES = ("total_spent_eur", "total_received_eur", "transfer_count")


def search_clubs(tables: Tables, text: str, limit: int = 10) -> DataFrame:
    """Clubs whose name contains the text in any case; % and _ are wildcards."""
    countries = tables.countries.select(
        F.col("id").alias("country_id"), F.col("name").alias("country_name")
    )
    leagues = tables.leagues.select(
        F.col("id").alias("current_league_id"), F.col("name").alias("league_name")
    )
    return (
        tables.clubs.filter(F.col("name").ilike(f"%{text}%"))
        .join(countries, "country_id")
        .join(leagues, "current_league_id", "left")
        .select(F.col("id").alias("club_id"), F.col("name").alias("club_name"), "country_name", "league_name")
        .orderBy("club_name", "club_id")
        .limit(limit)
    )


def center_club(tables: Tables, club_id: int) -> DataFrame:
    """The club with its country; empty for an unknown club."""
    countries = tables.countries.select(
        F.col("id").alias("country_id"), F.col("name").alias("country_name")
    )
    return (
        tables.clubs.filter(F.col("id") == club_id)
        .join(countries, "country_id", "left")
        .select(F.col("id").alias("club_id"), F.col("name").alias("club_name"), "country_id", "country_name")
    )


def network_legs(tables: Tables, club_id: int, filters: TransferFilters = ALL) -> DataFrame:
    """Filtered transfers of one club, seen from it: direction, counterparty, money.

    Loan fees count. A move from the club to itself gives both directions. All rows
    of one club may be most of the table, so nothing here groups by it.
    """
    buys, sells = F.col("to_club_id") == club_id, F.col("from_club_id") == club_id
    transfers = flt.on_transfer_columns(tables.transfers, filters).filter(buys | sells)
    known = lookups.with_player(transfers, tables.players, filters)
    fee, zero = F.coalesce("fee_eur", F.lit(0)), F.lit(0).cast("bigint")

    def leg(active: Column, direction: str, other: str, spent: Column, received: Column) -> Column:
        side = F.struct(
            F.lit(direction).alias("direction"),
            F.col(other).alias("counter_club_id"),
            spent.alias("total_spent_eur"),
            received.alias("total_received_eur"),
        )
        return F.when(active, side)

    legs = F.array_compact(
        F.array(
            leg(buys, "bought", "from_club_id", fee, zero),
            leg(sells, "sold", "to_club_id", zero, fee),
        )
    )
    return known.select(
        F.col("id").alias("transfer_id"),
        "player_id",
        "fee_eur",
        "fee_is_loan",
        "transfer_window",
        F.inline(legs),
    ).filter(tables.clubs.filter(F.col("id") == club_id).exists())


def _edge_sums() -> list[Column]:
    return [
        F.sum("total_spent_eur").alias("total_spent_eur"),
        F.sum("total_received_eur").alias("total_received_eur"),
        F.count("*").alias("transfer_count"),
    ]


def _with_counter_club(legs: DataFrame, clubs: DataFrame, *columns: Column) -> DataFrame:
    return legs.join(clubs.select(F.col("id").alias("counter_club_id"), *columns), "counter_club_id")


def club_network(tables: Tables, club_id: int, filters: TransferFilters = ALL) -> DataFrame:
    """Money and moves between a club and each counterparty country, in scope or not."""
    legs = network_legs(tables, club_id, filters)
    edges = (
        _with_counter_club(legs, tables.clubs, F.col("country_id"))
        .groupBy("country_id")
        .agg(*_edge_sums())
    )
    names = tables.countries.select(F.col("id").alias("country_id"), F.col("name").alias("country_name"))
    return edges.join(names, "country_id", "left").select(
        "country_id", F.coalesce("country_name", F.lit("Unknown")).alias("country_name"), *EDGE_MEASURES
    )


def _legs_with_country(
    tables: Tables, club_id: int, country_ids: list[int] | None, filters: TransferFilters
) -> DataFrame:
    """Legs against clubs of the given, existing countries (None means all)."""
    clubs = tables.clubs
    if country_ids is not None:
        clubs = clubs.filter(F.col("country_id").isin(country_ids))
    existing = tables.countries.select(F.col("id").alias("country_id"))
    clubs = clubs.join(existing, "country_id", "left_semi")
    return _with_counter_club(
        network_legs(tables, club_id, filters),
        clubs,
        F.col("name").alias("counter_club_name"),
        F.col("country_id").alias("counter_country_id"),
    )


def club_network_expanded(
    tables: Tables, club_id: int, country_id: int, filters: TransferFilters = ALL
) -> DataFrame:
    """Money and moves between a club and each club of one country."""
    legs = _legs_with_country(tables, club_id, [country_id], filters)
    return (
        legs.groupBy(F.col("counter_club_id").alias("club_id"), F.col("counter_club_name").alias("club_name"))
        .agg(*_edge_sums())
    )


def club_network_transfers(
    tables: Tables,
    club_id: int,
    country_id: int,
    filters: TransferFilters = ALL,
    counter_club_id: int | None = None,
) -> DataFrame:
    """The transfers behind the expanded edges, one flat row each, with both ends named."""
    legs = _legs_with_country(tables, club_id, [country_id], filters)
    if counter_club_id is not None:
        legs = legs.filter(F.col("counter_club_id") == counter_club_id)
    players = tables.players.select(
        F.col("id").alias("player_id"),
        F.col("name").alias("player_name"),
        F.col("transfermarkt_url").alias("player_transfermarkt_url"),
        "position_group",
    )
    center = tables.clubs.filter(F.col("id") == club_id).select("name").scalar()
    bought = F.col("direction") == "bought"
    other = F.col("counter_club_name")
    named = legs.join(players, "player_id").withColumn("center_name", center)
    return named.select(
        F.col("counter_club_id").alias("club_id"),
        "transfer_id",
        "direction",
        "player_name",
        "player_transfermarkt_url",
        F.when(bought, other).otherwise(F.col("center_name")).alias("from_club_name"),
        F.when(bought, F.col("center_name")).otherwise(other).alias("to_club_name"),
        "fee_eur",
        "fee_is_loan",
        "position_group",
        "transfer_window",
    )


def network_page(
    rows: DataFrame,
    sort_by: str = "fee",
    sort_order: str = "desc",
    page: int = 1,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """One page of network transfers; an unknown fee sorts below 0, dates by window text."""
    columns = {
        "fee": F.coalesce("fee_eur", F.lit(-1)),
        "player_name": F.col("player_name"),
        "date": F.col("transfer_window"),
    }
    ties = [F.col("transfer_id"), F.col("direction")]
    if sort_by in columns:
        first = columns[sort_by]
        ties.insert(0, first.asc() if sort_order == "asc" else first.desc())
    return rows.orderBy(*ties).offset((page - 1) * page_size).limit(page_size)


def nested_edges(edges: DataFrame, transfers: DataFrame) -> DataFrame:
    """Expanded edges with each of their transfers: one row a transfer, the edge beside it.

    One club pair may hold any number of transfers, so they stay rows and are never
    gathered into a list; rows have this shape at any size. The totals are those of the
    edge and repeat on its rows. A writer that wants nested lists can group the rows of
    the edges it shows, a page at a time.
    """
    item = F.struct(
        "transfer_id",
        "direction",
        "player_name",
        "player_transfermarkt_url",
        "fee_eur",
        "fee_is_loan",
        "position_group",
        "transfer_window",
    )
    return transfers.select("club_id", item.alias("transfer")).join(edges, "club_id").select(
        "club_id", "club_name", *EDGE_MEASURES, "transfer"
    )


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    links: DataFrame


def network_graph(
    tables: Tables,
    club_id: int,
    filters: TransferFilters = ALL,
    expanded: list[int] | None = None,
) -> Network:
    """The club network as typed nodes and links.

    The center club links to its counterparty countries; an expanded country links on
    to its clubs (None expands all). Sizes and weights are shares of the largest
    country edge: the square root for nodes, log10 for links.
    """
    none = F.lit(None).cast("bigint")
    center = center_club(tables, club_id)
    countries = club_network(tables, club_id, filters)
    legs = _legs_with_country(tables, club_id, expanded, filters)
    clubs = legs.groupBy("counter_country_id", "counter_club_id", "counter_club_name").agg(*_edge_sums())

    volume = F.col("total_spent_eur") + F.col("total_received_eur")
    largest = F.greatest(F.coalesce(countries.agg(F.max(volume)).scalar(), F.lit(1)), F.lit(1))
    country_edges = countries.select(
        F.concat(F.lit("club-"), F.lit(club_id).cast("string")).alias("source"),
        F.concat(F.lit("country-"), F.col("country_id").cast("string")).alias("target"),
        F.lit("country").alias("type"),
        F.col("country_name").alias("label"),
        *EDGE_MEASURES,
    )
    club_edges = clubs.select(
        F.concat(F.lit("country-"), F.col("counter_country_id").cast("string")).alias("source"),
        F.concat(F.lit("expanded-"), F.col("counter_club_id").cast("string")).alias("target"),
        F.lit("club").alias("type"),
        F.col("counter_club_name").alias("label"),
        *EDGE_MEASURES,
    )
    edges = (
        country_edges.unionByName(club_edges)
        .withColumn("volume", volume)
        .withColumn("largest", largest)
    )

    log_share = F.log10(F.greatest(F.col("volume"), F.lit(1)).cast("double")) / F.log10(
        F.col("largest").cast("double")
    )
    links = edges.select(
        "source",
        "target",
        "volume",
        F.when(F.col("largest") > 1, log_share).otherwise(0.0).alias("weight"),
        (F.col("total_spent_eur") > F.col("total_received_eur")).alias("net_spender"),
    )
    nodes = center.select(
        F.concat(F.lit("club-"), F.col("club_id").cast("string")).alias("node_id"),
        F.lit("center").alias("type"),
        F.col("club_name").alias("label"),
        *[none.alias(m) for m in EDGE_MEASURES],
        F.lit(None).cast("double").alias("size_share"),
    ).unionByName(
        edges.select(
            F.col("target").alias("node_id"),
            "type",
            "label",
            *EDGE_MEASURES,
            F.sqrt(F.col("volume") / F.col("largest")).alias("size_share"),
        )
    )
    return Network(nodes, links)
