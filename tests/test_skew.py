"""Hot keys: one club, player or copied row holds a large share of all rows.

Broadcasts are off, so joins shuffle as they would with large dimensions, and results
are compared with plain Python over the same rows.
"""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark.functions.ids import transfer_row_id
from flowspark.operators import aggregates, careers, merge, numbering
from flowspark.operators.filters import TransferFilters
from flowspark.plans import clubs as club_plans
from flowspark.plans import flows, quality
from flowspark.plans.tables import Tables

HOT = 1
ROWS = 30_000


@pytest.fixture(scope="module")
def shuffled(spark):
    """No broadcast joins, and a low bar for what counts as a skewed partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(ROWS):
        hot = i % 2 == 0
        day = None if rng.random() < 0.3 else date(2015, 1, 1) + timedelta(days=rng.randrange(3000))
        start = rng.randrange(2010, 2023)
        source, target = (HOT if hot else rng.randrange(2, 400)), rng.randrange(2, 400)
        if rng.random() < 0.5:
            source, target = target, source
        year = day.year if day else start
        half = "Summer" if day is None or day.month >= 6 else "Winter"
        out.append((HOT if hot else rng.randrange(2, 3000), source, target,
                    rng.choice([None, 0, rng.randrange(1, 10**9)]), rng.random() < 0.2,
                    f"{half} {year}", day, f"{start}-{start + 1}"))
    return out


@pytest.fixture(scope="module")
def tables(shuffled, rows):
    spark = shuffled
    transfers = spark.createDataFrame(
        rows, "player_id long, from_club_id long, to_club_id long, fee_eur long, fee_is_loan boolean, "
        "transfer_window string, transfer_date date, season string").repartition(12)
    transfers = transfers.withColumn("id", transfer_row_id(
        F.col("player_id"), F.col("transfer_date"), F.col("from_club_id"), F.col("to_club_id"))
    ).dropDuplicates(["id"])
    clubs = spark.range(1, 400).select(
        "id", F.concat(F.lit("Club "), F.col("id")).alias("name"), (F.col("id") % 7).cast("int").alias("country_id"))
    players = spark.range(1, 3000).select(
        "id", F.lit("P").alias("name"), F.lit("DEF").alias("position_group"),
        F.lit(date(1990, 1, 1)).alias("date_of_birth"), F.lit("u").alias("transfermarkt_url"))
    countries = spark.range(0, 7).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("C"), F.col("id")).alias("name"), (F.col("id") != 6).alias("in_scope"))
    return Tables(countries, None, clubs, players, transfers.persist(), None)


def local(df):
    return [r.asDict() for r in df.collect()]


def test_flows_split_the_hot_club(tables):
    flow = aggregates.country_flows_by_window(tables.transfers, tables.clubs)
    got = {(r.from_country_id, r.to_country_id, r.transfer_window): (r.total_fee_eur, r.transfer_count, r.loan_count)
           for r in flow.collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for r in local(tables.transfers):
        w = want[r["from_club_id"] % 7, r["to_club_id"] % 7, r["transfer_window"]]
        w[0] += 0 if r["fee_is_loan"] else r["fee_eur"] or 0
        w[2 if r["fee_is_loan"] else 1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    plan = flow._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_both_paths_agree(tables):
    stored = tables.with_aggregates()
    fast = TransferFilters(window_start="Summer 2016", window_end="Winter 2020", country_ids=[1, 3])
    slow = TransferFilters(**{**fast.__dict__, "age_min": -100})
    dated = Tables(**{**stored.__dict__, "transfers": tables.transfers.filter("transfer_date is not null"),
                      "country_transfer_flows": None})
    a = sorted(map(repr, flows.country_flows(dated, fast).select("*").orderBy("from_country_id").collect()))
    b = sorted(map(repr, flows.country_flows(dated, slow).select("*").orderBy("from_country_id").collect()))
    assert not fast.needs_raw_transfers and slow.needs_raw_transfers
    assert len(a) > 0 and [x.split("(")[1] for x in a] == [x.split("(")[1] for x in b]


def test_network_of_the_hot_club(tables):
    got = {r.country_id: (r.total_spent_eur, r.total_received_eur, r.transfer_count)
           for r in club_plans.club_network(tables, HOT).collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for r in local(tables.transfers):
        for own, other, side in (("to_club_id", "from_club_id", 0), ("from_club_id", "to_club_id", 1)):
            if r[own] == HOT:
                w = want[r[other] % 7]
                w[side] += r["fee_eur"] or 0
                w[2] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    edges = club_plans.club_network_expanded(tables, HOT, 3)
    rows = club_plans.club_network_transfers(tables, HOT, 3)
    lists = defaultdict(list)
    for r in club_plans.nested_edges(edges, rows).collect():
        lists[r.club_id, r.transfer_count].append(r.transfer.transfer_id)
    assert all(len(ids) == count for (_, count), ids in lists.items())
    assert sum(map(len, lists.values())) == rows.count()
    assert club_plans.club_network(tables, 99_999).count() == 0


def test_career_stints_of_the_hot_player(tables):
    got = sorted(
        ((r.player_id, r.transfer_id, r.is_opening, r.club_id, r.start_year, r.end_year)
         for r in careers.career_stints(tables.transfers, tables.clubs).collect()), key=repr)
    by_player = defaultdict(list)
    for r in local(tables.transfers):
        by_player[r["player_id"]].append(r)
    want = []
    for player, moves in by_player.items():
        moves.sort(key=lambda r: (r["transfer_date"] is None, r["transfer_date"] or date.min, r["id"]))
        years = [str(r["transfer_date"].year) if r["transfer_date"] else r["season"][:4] for r in moves]
        want.append((player, moves[0]["id"], True, moves[0]["from_club_id"], None, years[0]))
        for r, start, end in zip(moves, years, years[1:] + ["Present"]):
            want.append((player, r["id"], False, r["to_club_id"], start, end))
    assert got == sorted(want, key=repr)


def test_merge_of_many_copies(shuffled):
    rng = random.Random(3)
    stored = {(1, date(2020, 1, 1)): 5, (2, None): 6, (3, date(2020, 1, 1)): 7, (9, None): 8}
    copies = [(1, date(2020, 1, 1), rng.choice([5, 5, 5, 4, 3]), i) for i in range(0, 6000, 2)]
    copies += [(rng.randrange(2, 200), rng.choice([None, date(2020, 1, 1)]), rng.randrange(3), i)
               for i in range(1, 6000, 2)]
    copies += [(9, None, 8, 7000 + i) for i in range(5)]
    snapshot = shuffled.createDataFrame(copies, "k long, d date, v int, o int").repartition(9)
    current = shuffled.createDataFrame([(*k, v) for k, v in stored.items()], "k long, d date, v int")
    merged = merge.merge_snapshot(current, snapshot, ["k", "d"], ["v"], "o", nullable=("d",))
    got = {(r.k, r.d): (r.v, r._change, r._rows) for r in merged.collect()}

    want = {k: (v, "kept", 0) for k, v in stored.items()}
    by_key = defaultdict(list)
    for k, d, v, o in sorted(copies, key=lambda c: c[3]):
        by_key[k, d].append(v)
    for key, values in by_key.items():
        if key not in stored:
            want[key] = (values[0], "insert", len(values))
            continue
        differing = [v for v in values if v != stored[key]]
        want[key] = (differing[-1], "update", len(values)) if differing else (stored[key], "unchanged", len(values))
    assert got == want


def test_first_per_key_and_orphans(tables, shuffled):
    rows = shuffled.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("player_id"), F.col("id").alias("o"),
        (F.col("id") * 2).alias("v"))
    first = {r.player_id: r.v for r in merge.first_per_key(rows, ["player_id"], "o").collect()}
    assert first[1] == 0 and first[2] == 4 and len(first) == 3333
    orphans = {r.player_id: r.row_count for r in quality.orphans(rows, shuffled.range(2, 6000)).collect()}
    assert orphans == {1: 1668}


def test_dense_ids(shuffled):
    keys = shuffled.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("key")).repartition(7)
    numbered = numbering.dense_ids(keys, "key", F.lit(100), buckets=16)
    ids = {r.key: r.id for r in numbered.collect()}
    assert sorted(ids.values()) == list(range(101, 2101))
    again = numbering.dense_ids(keys.repartition(3), "key", F.lit(100), buckets=16)
    assert ids == {r.key: r.id for r in again.collect()}
