"""Every registered query: name to (spark, sf_dir) -> DataFrame."""

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowspark.checks.sample import Sample
from flowspark.functions import money, people, seasons, text
from flowspark.operators import aggregates, merge, resolve
from flowspark.operators import filters as flt
from flowspark.operators.filters import TransferFilters
from flowspark.operators.lookups import with_player
from flowspark.plans import clubs, countries, flows, load, players, quality, windows
from flowspark.sources import contract
from flowspark.sources.snapshot import MALFORMED, ORDINAL, read_snapshot
from flowspark.sources.store import freshness

# Parameters, the same in the SQL.
COUNTRY, COUNTERPART = 3, 7
CLUB, PLAYER = 10, 12
AS_OF = date(1999, 6, 1)
FILTERS = TransferFilters(
    window_start="Summer 1996",
    window_end="Winter 1999",
    transfer_type="paid",
    fee_min=1_000_000,
    position_groups=["DEF", "MID"],
    age_min=20,
    age_max=33,
)
RANGE = TransferFilters(window_start="Summer 1996", window_end="Winter 1999")

_REGISTRY: dict[str, Callable[[Sample], DataFrame]] = {}


def _query(build: Callable[[Sample], DataFrame]) -> Callable[[Sample], DataFrame]:
    _REGISTRY[build.__name__] = build
    return build


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Sample], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Sample(spark, sf_dir))

    return {name: bind(build) for name, build in _REGISTRY.items()}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- normalisation ---------------------------------------------------------------


@_query
def ids_normalized(s: Sample) -> DataFrame:
    raw = s.raw_transfers
    return raw.select(
        F.col("player_id").alias("raw_player_id"),
        text.id_text(F.col("player_id")).alias("player_id"),
        text.id_text(F.col("from_club_id")).alias("from_club_id"),
        text.id_text(F.col("to_club_id")).alias("to_club_id"),
    )


@_query
def fee_normalized(s: Sample) -> DataFrame:
    return money.with_fee(s.raw_transfers.select("transfer_fee"), "transfer_fee")


@_query
def window_derived(s: Sample) -> DataFrame:
    day = text.parse_date(F.col("transfer_date"))
    return s.raw_transfers.select(
        "transfer_date",
        "transfer_season",
        seasons.derive_window(day, F.col("transfer_season")).alias("transfer_window"),
    )


@_query
def season_normalized(s: Sample) -> DataFrame:
    rows = seasons.with_season(s.raw_transfers.select("transfer_season"), "transfer_season")
    return rows.withColumnRenamed("season_start", "start_year")


@_query
def position_grouped(s: Sample) -> DataFrame:
    return s.players.select("id", "position", "position_group")


@_query
def transfer_row_id(s: Sample) -> DataFrame:
    return s.transfers.select("player_id", "transfer_date", "from_club_id", "to_club_id", "id")


@_query
def windows_sorted(s: Sample) -> DataFrame:
    return windows.available_windows(s.transfers)


@_query
def windows_sorted_calendar(s: Sample) -> DataFrame:
    return windows.available_windows(s.transfers, "calendar")


@_query
def age_at_transfer(s: Sample) -> DataFrame:
    born = s.players.select(F.col("id").alias("player_id"), "date_of_birth")
    return s.transfers.join(born, "player_id").select(
        "id", people.age_at(F.col("transfer_date"), F.col("date_of_birth")).alias("age")
    )


# --- filters ---------------------------------------------------------------------

_SHOWN = ("id", "player_id", "fee_eur", "transfer_window")


@_query
def filter_window_range(s: Sample) -> DataFrame:
    return flt.in_window_range(s.transfers, RANGE).select(*_SHOWN)


@_query
def filter_paid(s: Sample) -> DataFrame:
    return flt.of_type(s.transfers, "paid").select(*_SHOWN)


@_query
def filter_free(s: Sample) -> DataFrame:
    return flt.of_type(s.transfers, "free").select(*_SHOWN)


@_query
def filter_fee_range(s: Sample) -> DataFrame:
    return flt.in_fee_range(s.transfers, 1_000_000, 3_000_000).select(*_SHOWN)


@_query
def filter_position(s: Sample) -> DataFrame:
    filters = TransferFilters(position_groups=["GK", "FWD"])
    return with_player(s.transfers, s.players, filters).select(*_SHOWN)


@_query
def filter_age(s: Sample) -> DataFrame:
    filters = TransferFilters(age_min=21, age_max=29)
    return with_player(s.transfers, s.players, filters).select(*_SHOWN)


@_query
def filter_country(s: Sample) -> DataFrame:
    return flows.country_flows(s.tables, TransferFilters(country_ids=[COUNTRY, COUNTERPART]))


# --- aggregates and flows --------------------------------------------------------


@_query
def country_flows_by_window(s: Sample) -> DataFrame:
    return aggregates.country_flows_by_window(s.transfers, s.clubs).drop("window_key")


@_query
def club_summaries_by_window(s: Sample) -> DataFrame:
    return aggregates.club_summaries_by_window(s.transfers).drop("window_key")


@_query
def country_flows(s: Sample) -> DataFrame:
    return flows.country_flows(s.tables, RANGE)


@_query
def country_flows_filtered(s: Sample) -> DataFrame:
    return flows.country_flows(s.tables, FILTERS)


@_query
def country_net_spend(s: Sample) -> DataFrame:
    return flows.country_net_spend(s.tables)


@_query
def net_pair_flows(s: Sample) -> DataFrame:
    return _rounded(flows.net_pair_flows(s.tables), "magnitude_share")


@_query
def net_pair_flows_free(s: Sample) -> DataFrame:
    free = TransferFilters(transfer_type="free")
    return _rounded(flows.net_pair_flows(s.tables, free), "magnitude_share")


@_query
def country_node_totals(s: Sample) -> DataFrame:
    return _rounded(flows.country_node_totals(s.tables), "size_share", "net_share")


# --- country detail --------------------------------------------------------------


@_query
def countries_in_scope(s: Sample) -> DataFrame:
    return countries.countries_in_scope(s.tables)


@_query
def top_clubs(s: Sample) -> DataFrame:
    return countries.top_lists(countries.club_totals(s.tables, COUNTRY, RANGE))


@_query
def country_header(s: Sample) -> DataFrame:
    totals = countries.club_totals(s.tables, COUNTRY, RANGE)
    return countries.country_header(s.tables, COUNTRY, totals)


@_query
def country_pair_clubs(s: Sample) -> DataFrame:
    return countries.club_totals(s.tables, COUNTRY, RANGE, COUNTERPART)


@_query
def country_pair_totals(s: Sample) -> DataFrame:
    totals = countries.club_totals(s.tables, COUNTRY, RANGE, COUNTERPART)
    return countries.country_pair_totals(totals)


@_query
def country_transfers_page(s: Sample) -> DataFrame:
    rows = countries.country_transfers(s.tables, COUNTRY, FILTERS)
    return countries.page_of(rows, "fee", "desc", page=2)


@_query
def country_transfers_by_name(s: Sample) -> DataFrame:
    rows = countries.country_transfers(s.tables, COUNTRY, RANGE)
    return countries.page_of(rows, "player_name", "asc")


@_query
def country_transfers_direction(s: Sample) -> DataFrame:
    return countries.country_transfers(s.tables, COUNTRY, RANGE, direction="buying")


@_query
def country_pair_transfers(s: Sample) -> DataFrame:
    both = countries.country_transfers(s.tables, COUNTRY, RANGE, COUNTERPART)
    selling = countries.country_transfers(s.tables, COUNTRY, RANGE, COUNTERPART, "selling")
    return both.withColumn("variant", F.lit("both")).unionByName(
        selling.withColumn("variant", F.lit("selling"))
    )


@_query
def country_transfers_total(s: Sample) -> DataFrame:
    return countries.total_of(countries.country_transfers(s.tables, COUNTRY, FILTERS))


@_query
def country_flows_located(s: Sample) -> DataFrame:
    """Filtered flows from stored transfers that carry their countries: no join with clubs."""
    return flows.country_flows(s.located_tables, replace(FILTERS, country_ids=[COUNTRY, COUNTERPART]))


@_query
def country_transfers_located(s: Sample) -> DataFrame:
    return countries.country_transfers(s.located_tables, COUNTRY, RANGE, direction="buying")


# --- clubs -----------------------------------------------------------------------


@_query
def club_search(s: Sample) -> DataFrame:
    return clubs.search_clubs(s.tables_with_leagues, "ER#0000000_1", 20)


@_query
def club_network(s: Sample) -> DataFrame:
    return clubs.club_network(s.tables, CLUB, RANGE)


@_query
def club_network_filtered(s: Sample) -> DataFrame:
    return clubs.club_network(s.tables, CLUB, FILTERS)


@_query
def club_network_expanded(s: Sample) -> DataFrame:
    return clubs.club_network_expanded(s.tables, CLUB, COUNTRY, RANGE)


@_query
def club_network_transfers(s: Sample) -> DataFrame:
    return clubs.club_network_transfers(s.tables, CLUB, COUNTRY, RANGE)


@_query
def club_network_page(s: Sample) -> DataFrame:
    rows = clubs.club_network_transfers(s.tables, CLUB, COUNTRY)
    return clubs.network_page(rows, "fee", "desc", page=2)


@_query
def club_network_lists(s: Sample) -> DataFrame:
    edges = clubs.club_network_expanded(s.tables, CLUB, COUNTRY, RANGE)
    rows = clubs.club_network_transfers(s.tables, CLUB, COUNTRY, RANGE)
    nested = clubs.nested_edges(edges, rows)
    return nested.select(
        "club_id", "club_name", *clubs.EDGE_MEASURES,
        *[F.col("transfer")[c].alias(c) for c in ("transfer_id", "direction", "fee_eur", "transfer_window")],
    )


@_query
def network_nodes(s: Sample) -> DataFrame:
    return _rounded(clubs.network_graph(s.tables, CLUB, expanded=[COUNTRY, COUNTERPART]).nodes, "size_share")


@_query
def network_edges(s: Sample) -> DataFrame:
    return _rounded(clubs.network_graph(s.tables, CLUB, expanded=[COUNTRY, COUNTERPART]).links, "weight")


# --- players ---------------------------------------------------------------------


@_query
def player_search(s: Sample) -> DataFrame:
    return players.search_players(s.tables, "RED", 15)


@_query
def player_profile(s: Sample) -> DataFrame:
    return players.player_profile(s.tables, PLAYER, AS_OF)


@_query
def player_history(s: Sample) -> DataFrame:
    return players.player_history(s.tables, PLAYER)


@_query
def player_valuations(s: Sample) -> DataFrame:
    return players.player_valuations(s.tables, PLAYER)


@_query
def player_value_series(s: Sample) -> DataFrame:
    return players.value_series(s.tables)


@_query
def career_stints(s: Sample) -> DataFrame:
    return players.career_stints(s.tables)


# --- ingest ----------------------------------------------------------------------


@_query
def ingest_reject_counts(s: Sample) -> DataFrame:
    typed = resolve.transfer_rows(s.raw_transfers, "_ordinal")
    resolved = resolve.resolve_transfers(typed, s.external_players, s.external_clubs, "_ordinal")
    return resolve.outcome_counts(resolved)


@_query
def ingest_accepted(s: Sample) -> DataFrame:
    typed = resolve.transfer_rows(s.raw_transfers, "_ordinal")
    resolved = resolve.resolve_transfers(typed, s.external_players, s.external_clubs, "_ordinal")
    return resolve.accepted(resolved).select(*load.TRANSFER_KEY, *load.TRANSFER_VALUES)


@_query
def valuation_reject_counts(s: Sample) -> DataFrame:
    typed = resolve.valuation_rows(s.raw_valuations, "_ordinal")
    return resolve.outcome_counts(resolve.resolve_valuations(typed, s.external_players, "_ordinal"))


@_query
def valuation_dedup(s: Sample) -> DataFrame:
    return s.player_valuations.select("player_id", "valuation_date", "valuation_eur")


@_query
def merge_transfers(s: Sample) -> DataFrame:
    merged = load.merge_transfers(s.stored_transfers, s.transfer_snapshot)
    return merged.select(
        "id", *load.TRANSFER_KEY, *load.TRANSFER_VALUES,
        F.col(merge.CHANGE).alias("change"), F.col(merge.ROWS).alias("row_count"),
    )


@_query
def merge_change_counts(s: Sample) -> DataFrame:
    return merge.change_counts(load.merge_transfers(s.stored_transfers, s.transfer_snapshot))


@_query
def merge_valuations(s: Sample) -> DataFrame:
    snapshot = s.valuation_rows.withColumnRenamed("event_id", "_ordinal")
    merged = load.merge_valuations(s.stored_valuations, snapshot)
    return merged.select(
        *load.VALUATION_KEY, "valuation_eur",
        F.col(merge.CHANGE).alias("change"), F.col(merge.ROWS).alias("row_count"),
    )


@_query
def country_iso_codes(s: Sample) -> DataFrame:
    needed = resolve.needed_countries(s.raw_competitions, s.club_countries, "_ordinal")
    needed = s.staged("needed_countries", needed)
    return resolve.new_countries(s.spark, needed, s.countries, s.staged)


@_query
def league_matching(s: Sample) -> DataFrame:
    return resolve.match_leagues(s.leagues, s.customer_competitions, "_ordinal").select(
        "id", "name", "transfermarkt_id"
    )


@_query
def club_country_resolution(s: Sample) -> DataFrame:
    return s.club_countries.select("transfermarkt_id", "name", "country_name")


@_query
def merge_players(s: Sample) -> DataFrame:
    merged = s.staged("merged", load.merge_players(s.stored_players, s.raw_players))
    numbered = load.number_new(merged, s.stored_players)
    known = F.when(F.col(merge.CHANGE) != "insert", F.col("id"))
    return numbered.select(
        known.alias("id"), "transfermarkt_id", *load.PLAYER_VALUES,
        F.col(merge.CHANGE).alias("change"), F.col(merge.ROWS).alias("row_count"),
    )


@_query
def new_player_ids(s: Sample) -> DataFrame:
    merged = s.staged("merged", load.merge_players(s.stored_players, s.raw_players))
    fresh = load.number_new(merged, s.stored_players).filter(F.col(merge.CHANGE) == "insert")
    return fresh.agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count("*").alias("row_count"), F.countDistinct("id").alias("distinct_ids"),
    )


@_query
def merge_clubs(s: Sample) -> DataFrame:
    resolved = resolve.club_keys(s.club_countries, s.countries, s.external_leagues)
    merged = s.staged("merged", load.merge_clubs(s.stored_clubs, resolved))
    numbered = load.number_new(merged, s.stored_clubs)
    known = F.when(F.col(merge.CHANGE) != "insert", F.col("id"))
    return numbered.select(
        known.alias("id"), "transfermarkt_id", "name", "country_id", "current_league_id",
        F.col(merge.CHANGE).alias("change"), F.col(merge.ROWS).alias("row_count"),
    )


def _changes(s: Sample) -> DataFrame:
    """Staged changes of the transfers: what they add, less the values that updates replaced.

    The merge is written as that alone; most of its bytes are ids and rows that no aggregate reads.
    """
    merged = load.merge_transfers(s.stored_transfers, s.transfer_snapshot)
    return s.staged("changes", aggregates.signed_changes(merged.filter(F.col(merge.CHANGE).isin("insert", "update"))))


@_query
def country_flows_by_change(s: Sample) -> DataFrame:
    """Stored flows with the changes of a merge applied, instead of a rebuild."""
    stored = aggregates.country_flows_by_window(s.stored_transfers, s.clubs)
    deltas = aggregates.flow_deltas(_changes(s), s.clubs)
    return aggregates.with_deltas(stored, deltas, aggregates.FLOW_MEASURES, aggregates.FLOW_COUNTS).drop("window_key")


@_query
def club_summaries_by_change(s: Sample) -> DataFrame:
    stored = aggregates.club_summaries_by_window(s.stored_transfers)
    deltas = aggregates.club_deltas(_changes(s))
    return aggregates.with_deltas(stored, deltas, aggregates.CLUB_MEASURES, aggregates.CLUB_COUNTS).drop("window_key")


@_query
def load_counts(s: Sample) -> DataFrame:
    """Outcomes of both facts, observed while the resolved rows are staged."""
    transfers = resolve.resolve_transfers(
        resolve.transfer_rows(s.raw_transfers, "_ordinal"), s.external_players, s.external_clubs, "_ordinal"
    )
    valuations = resolve.resolve_valuations(
        resolve.valuation_rows(s.raw_valuations, "_ordinal"), s.external_players, "_ordinal"
    )
    rows = []
    for table, resolved, outcomes in (
        ("transfers", transfers, resolve.TRANSFER_OUTCOMES), ("player_valuations", valuations, resolve.VALUATION_OUTCOMES)
    ):
        _, counts = load.stage_counted(s.staged, table, resolved, outcomes)
        rows += [(table, outcome, n) for outcome, n in counts.items()]
    return s.spark.createDataFrame(rows, "table_name string, outcome string, row_count long")


@_query
def load_log_freshness(s: Sample) -> DataFrame:
    """The load record of a published table: rows observed at the write, and its age."""
    store, seen = s.new_store(), Observation()
    store.write("players", "v1", s.stored_players, seen, [F.count("*").alias("rows")])
    at = datetime(1999, 4, 1, 12, tzinfo=timezone.utc)
    store.publish({"players": "v1"}, seen.get["rows"], "sample", at, counts={"players": seen.get["rows"]})
    fresh = freshness(store.latest(), datetime(1999, 6, 1, tzinfo=timezone.utc))
    return fresh.withColumn("last_ingestion_at", F.col("last_ingestion_at").cast("date"))


@_query
def publish_versions(s: Sample) -> DataFrame:
    """Facts in parts: a second version that writes two years only and takes over the others."""
    store = s.new_store()
    store.write("player_valuations", "v1", s.player_valuations.drop("event_id"))
    store.publish({"player_valuations": "v1"}, 0, None, datetime(1999, 1, 1, tzinfo=timezone.utc))
    parts = {p.part: p for p in store.parts("player_valuations", "v1")}
    last = sorted(parts)[-1]
    raised = store.read("player_valuations", "v1", [last]).withColumn("valuation_eur", F.col("valuation_eur") + 1)
    store.write("player_valuations", "v2", raised)
    parts |= {p.part: p for p in store.parts("player_valuations", "v2")}
    store.set_parts("player_valuations", "v2", list(parts.values()))
    store.publish({"player_valuations": "v2"}, 0, None, datetime(1999, 2, 1, tzinfo=timezone.utc), based_on=1)
    return store.read_current("player_valuations").withColumn("loads", F.lit(store.load_log().count()))


@_query
def csv_scan_counts(s: Sample) -> DataFrame:
    """Raw transfers written as CSV part files and read back under the contract."""
    folder = s.shared_folder()
    wanted = sorted(contract.REQUIRED_COLUMNS["transfers.csv"])
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    s.raw_transfers.select(*wanted).write.options(**plain).csv(f"{folder}/transfers.csv")
    rows = read_snapshot(s.spark, folder, "transfers.csv")
    fee = F.coalesce("transfer_fee", F.lit(""))
    return rows.groupBy(F.coalesce("transfer_season", F.lit("")).alias("transfer_season")).agg(
        F.count("*").alias("row_count"),
        F.countDistinct(ORDINAL).alias("ordinals"),
        F.count_if(MALFORMED).alias("malformed"),
        F.count_if(text.id_text(F.col("player_id")).isNotNull()).alias("with_player"),
        F.sum(F.length(fee)).alias("fee_characters"),
    )


# --- quality ---------------------------------------------------------------------

_RESULT = ("name", "severity", "passed", "message")


@_query
def dq_row_counts(s: Sample) -> DataFrame:
    return quality.row_counts(s.tables).select(*_RESULT)


@_query
def dq_orphan_transfers(s: Sample) -> DataFrame:
    return quality.orphans(s.transfers, s.players_without_size_7)


@_query
def dq_orphan_valuations(s: Sample) -> DataFrame:
    return quality.orphans(s.player_valuations, s.players_without_size_7)


@_query
def dq_reconciliation(s: Sample) -> DataFrame:
    return quality.reconciliation(s.tables).select(*_RESULT)


@_query
def dq_reconciliation_cases(s: Sample) -> DataFrame:
    """Stored flows that equal the transfers, that differ from them, and that are not built."""
    stored = s.staged("flows", aggregates.country_flows_by_window(s.transfers, s.clubs))
    more = F.when(F.col("from_country_id") == COUNTRY, F.col("loan_count") + 1).otherwise(F.col("loan_count"))
    cases = {"equal": stored, "differs": stored.withColumn("loan_count", more), "not_built": stored.limit(0)}
    found = [
        quality.reconciliation(replace(s.tables, country_transfer_flows=flows)).select(F.lit(case).alias("case"), *_RESULT)
        for case, flows in cases.items()
    ]
    return reduce(DataFrame.unionByName, found)


@_query
def dq_details(s: Sample) -> DataFrame:
    """The details of the checks of dates, fees, windows and orphans, with limits that find some."""
    tables = replace(s.tables, transfers=s.odd_windows, players=s.players_without_size_7)
    limits = quality.Limits(future_days=-1500, outlier_fee_eur=40_000, distinct_fees=10_000_000)
    report = quality.quality_report(tables, AS_OF, limits)
    chosen = report.filter(F.col("name").isin(
        "no_far_future_transfers", "no_outlier_fees", "transfer_window_format", "no_orphan_transfers",
        "fee_distribution_not_degenerate",
    ))
    return chosen.select("name", "passed", F.explode("details").alias("detail", "value"))


@_query
def dq_bad_windows(s: Sample) -> DataFrame:
    return quality.bad_windows(s.odd_windows)


@_query
def dq_duplicate_keys(s: Sample) -> DataFrame:
    return aggregates.duplicate_keys(s.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@_query
def dq_report(s: Sample) -> DataFrame:
    return quality.quality_report(s.tables, AS_OF).select(*_RESULT)
