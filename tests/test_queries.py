"""Query behaviour that the SQL comparison does not reach."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from flowspark.checks.sample import Sample
from flowspark.operators import filters as flt
from flowspark.operators.filters import TransferFilters
from flowspark.plans import clubs, countries, flows, players, windows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Sample(spark, SF_DIR).tables


def test_routing():
    assert not TransferFilters(window_start="Summer 2000", country_ids=[1]).needs_raw_transfers
    for raw in (dict(fee_min=1), dict(fee_max=1), dict(transfer_type="paid"), dict(age_min=1),
                dict(age_max=1), dict(position_groups=["GK"])):
        assert TransferFilters(**raw).needs_raw_transfers
    assert not TransferFilters(fee_max=1).needs_players


def test_fast_path_equals_slow_path(spark, tables):
    fast = TransferFilters(window_start="Summer 1996", window_end="Winter 1999", country_ids=[3, 7])
    slow = TransferFilters(**{**fast.__dict__, "position_groups": ["GK", "DEF", "MID", "FWD"]})
    in_groups = tables.players.filter("position_group is not null").select(F.col("id").alias("player_id"))
    known = type(tables)(**{**tables.__dict__, "transfers": tables.transfers.join(in_groups, "player_id", "left_semi")})
    columns = ["from_country_id", "to_country_id", "total_fee_eur", "transfer_count", "loan_count"]
    a = flows.country_flows(known, fast).select(columns)
    b = flows.country_flows(known, slow).select(columns)
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_window_range_edges(tables):
    all_rows = tables.transfers.count()

    def count(**kw):
        return flt.in_window_range(tables.transfers, TransferFilters(**kw)).count()

    assert count() == all_rows
    assert count(window_start="no window") == all_rows  # sorts before every window
    assert count(window_end="no window") == 0
    assert count(window_start="", window_end="") == all_rows
    label = count(window_start="Winter 1998", window_end="Winter 1998")
    assert label == count(window_start="Winter 1998", window_end="Winter 1998", window_order="calendar") > 0
    # Winter follows Summer of its year by label and precedes it in the calendar
    assert count(window_start="Winter 1998", window_end="Summer 1998") == 0
    assert count(window_start="Winter 1998", window_end="Summer 1998", window_order="calendar") > label


def test_unknown_entities_are_empty(tables):
    out_of_scope = tables.countries.filter("not in_scope").first().id
    for country in (out_of_scope, 999):
        detail = countries.country_detail(tables, country)
        assert detail.header.isEmpty() and detail.top_buying_clubs.isEmpty() and detail.transfers.isEmpty()
        assert detail.total.first().total == 0
    assert clubs.club_network(tables, 10**9).isEmpty()
    assert clubs.network_graph(tables, 10**9).nodes.isEmpty()
    assert players.player_detail(tables, 10**9, date(2000, 1, 1)).profile.isEmpty()


def test_detail_parts_fit(tables):
    detail = countries.country_detail(tables, 3, page_size=7)
    header, top = detail.header.first(), detail.top_buying_clubs.collect()
    sold = detail.top_selling_clubs.collect()
    assert header.net_spend_top5 == sum(r.total_spent_eur for r in top) - sum(r.total_received_eur for r in sold)
    assert detail.transfers.count() == 7 < detail.total.first().total


def test_pages_are_disjoint_and_sorted(tables):
    rows = countries.country_transfers(tables, 3).cache()
    first = countries.page_of(rows, "unknown field", "sideways", 1, 10).collect()
    second = countries.page_of(rows, "fee", "desc", 2, 10).collect()
    fees = [r.fee_eur for r in first + second]
    assert fees == sorted(fees, reverse=True)
    assert len({r.transfer_id for r in first + second}) == 20
    last = countries.page_of(rows, "fee", "asc", 1, 10**6).collect()
    assert last[-1].fee_eur is None and last[0].fee_eur == 0
    rows.unpersist()


def test_wildcards(spark, tables):
    assert players.search_players(tables, "r_d ", 500).count() == players.search_players(tables, "RED ", 500).count() > 0
    with_leagues = Sample(spark, SF_DIR).tables_with_leagues
    assert clubs.search_clubs(with_leagues, "no such club").isEmpty()


def test_graph_links_meet_nodes(tables):
    graph = clubs.network_graph(tables, 10)
    nodes = {r.node_id for r in graph.nodes.collect()}
    links = graph.links.collect()
    assert {r.source for r in links} | {r.target for r in links} == nodes
    assert all(0 <= r.weight for r in links)


def test_windows_in_order(tables):
    keys = [r.sort_key for r in windows.available_windows(tables.transfers).collect()]
    assert keys == sorted(keys)


def test_plan_shape(spark):
    """Columns are pruned and the fee filter runs in front of every join."""
    s = Sample(spark, SF_DIR)
    plan = flows.country_flows(s.tables, TransferFilters(fee_min=5))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet [l_" in line)
    assert "l_linenumber" not in scan and "l_shipdate" not in scan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cross_joins(spark):
    import __spark_entry__ as contract

    for name, build in contract.queries().items():
        plan = build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_stints_read_transfers_once(spark):
    from flowspark.checks.sample import Sample
    from flowspark.plans import players

    found = players.career_stints(Sample(spark, SF_DIR).tables)
    found.toArrow()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Initial Plan")].count("FileScan parquet [l_orderkey") == 1
