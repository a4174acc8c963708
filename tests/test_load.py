"""Raw snapshot loads from fixture CSV files."""

import gzip
import logging
import random
import shutil
from collections import Counter
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowspark.operators import merge
from flowspark.operators.filters import TransferFilters
from flowspark.plans import load
from flowspark.plans.countries import country_transfers
from flowspark.plans.flows import country_flows
from flowspark.sources import seeds
from flowspark.sources.contract import SchemaValidationError, check_columns
from flowspark.sources.snapshot import ORDINAL, AmbiguousFileError, read_csv, read_snapshot
from flowspark.sources.store import DuplicateKeyError, PublishConflictError, TableStore, freshness, row_counts
from tests.conftest import write_csv

AT = datetime(2024, 6, 1, tzinfo=timezone.utc)


def competition(cid, name, country):
    return {"competition_id": cid, "name": name, "country_name": country}


def player(pid, name, born="", position="", sub="", country="", url=""):
    return {"player_id": pid, "name": name, "date_of_birth": born, "position": position,
            "sub_position": sub, "country_of_citizenship": country, "url": url}


def club(cid, name, comp, url=""):
    return {"club_id": cid, "name": name, "domestic_competition_id": comp, "url": url}


def transfer(pid, day, season, source, target, fee):
    return {"player_id": pid, "transfer_date": day, "transfer_season": season,
            "from_club_id": source, "to_club_id": target, "from_club_name": "", "to_club_name": "",
            "transfer_fee": fee, "market_value_in_eur": "", "player_name": ""}


def valuation(pid, day, value):
    return {"player_id": pid, "date": day, "market_value_in_eur": value}


COMPETITIONS = [competition("GB1", "Premier League", "England"), competition("ES1", "LaLiga", "Spain")]
PLAYERS = [
    player("7001", "Ines", "1991-11-30", "goalkeeper", "Goalkeeper", "Portugal", "/p/ines"),
    player("7002.0", "Juno", "3 Mar 1997", "defender", "Left-Back", "", "/p/juno"),
    player("7003", "Kofi", "02/28/2001", "attack", "Right Winger", "Ghana", "/p/kofi"),
    player("7004", "NA", "unknown"),
    player("nan", "Nobody"),
]
CLUBS = [
    club("81", "Harbour", "ES1", "/c/harbour"),
    club("82", "Ironworks", "GB1", "/c/ironworks"),
    club("83", "Juniper", "ES1", "/c/juniper"),
    club("84", "AS Monaco", "ES1", "/c/monaco"),
    club("85", "Kite Hill", "ZZ0", "/c/kite"),
    club("NULL", "No Key", "ES1"),
]
# (row, outcome): the expected counts are taken from the outcomes.
TRANSFER_CASES = [
    (transfer("7003", "2021-08-31", "21/22", "82", "83", "€1.25m"), "accepted"),
    (transfer("7001", "2022-01-09", "21/22", "83", "81", "free transfer"), "accepted"),
    (transfer("7002", "12/20/2020", "20/21", "81", "82", "?"), "accepted"),
    (transfer("7002", "", "19/20", "83", "82", "€300k"), "accepted"),
    (transfer("7001", "some day", "18/19", "82", "81", "40"), "accepted_unread_date"),
    (transfer("7003", "2019-06-30", "18/19", "83", "82", "End of loan"), "excluded_fee"),
    (transfer("n/a", "2021-08-31", "21/22", "82", "83", "10"), "missing_player"),
    (transfer("7003", "2021-08-30", "21/22", "82", "", "10"), "missing_club"),
    (transfer("7002", "", "", "81", "83", "10"), "no_window_or_season"),
    (transfer("7001", "2020-02-02", "", "81", "83", "10"), "no_window_or_season"),
    (transfer("6666", "2021-08-31", "21/22", "82", "83", "10"), "unknown_player"),
    (transfer("7001", "2021-07-04", "21/22", "8888", "83", "10"), "unknown_club"),
    (transfer("7001", "2021-07-05", "21/22", "83", "8888", "10"), "unknown_club"),
]
TRANSFERS = [row for row, _ in TRANSFER_CASES]
VALUATION_CASES = [
    (valuation("7001", "2020-12-31", "1500000"), "accepted"),
    (valuation("7001", "June 30, 2021", "1750000.5"), "accepted"),
    (valuation("7003", "2021/12/15", "8000000"), "accepted"),
    (valuation("7002", "2021-12-15", "NaN"), "missing_value"),
    (valuation("7002", "", "900000"), "missing_date"),
    (valuation("7002", "spring", "900000"), "unread_date"),
    (valuation("", "2021-12-15", "900000"), "missing_player"),
    (valuation("6666", "2021-12-15", "900000"), "unknown_player"),
]
VALUATIONS = [row for row, _ in VALUATION_CASES]
FILES = {"competitions.csv": COMPETITIONS, "players.csv": PLAYERS, "clubs.csv": CLUBS,
         "transfers.csv": TRANSFERS, "player_valuations.csv": VALUATIONS}


def snapshot(folder, **changes):
    folder.mkdir(exist_ok=True)
    for name, rows in FILES.items():
        write_csv(folder / name, changes.get(name.removesuffix(".csv"), rows))
    return str(folder)


@pytest.fixture()
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "tables"))
    countries = spark.createDataFrame(
        [(1, "England", "ENG", 51.5, -0.1, True), (2, "Spain", "ESP", 40.4, -3.7, True),
         (3, "Other", "OTH", 0.0, 0.0, False)],
        "id int, name string, iso_code string, latitude double, longitude double, in_scope boolean")
    leagues = spark.createDataFrame(
        [(1, "Premier League", 1, 1, None), (2, "LaLiga", 2, 1, None)],
        "id int, name string, country_id int, tier int, transfermarkt_id string")
    load.seed(store, datetime(2024, 5, 1, tzinfo=timezone.utc), countries, leagues)
    return store


def ids(df):
    return {r.transfermarkt_id: r.id for r in df.collect()}


def transfer_set(tables):
    p = {v: k for k, v in ids(tables.players).items()}
    c = {v: k for k, v in ids(tables.clubs).items()}
    return {
        (p[r.player_id], r.transfer_date, c[r.from_club_id], c[r.to_club_id]):
            (r.fee_eur, r.fee_is_loan, r.transfer_window, r.season)
        for r in tables.transfers.collect()
    }


def counted(cases, table):
    return {f"{table}.{outcome}": n for outcome, n in Counter(o for _, o in cases).items()}


def test_full_load_twice(spark, store, tmp_path):
    folder = snapshot(tmp_path / "raw")
    first = load.run_load(store, folder, "abc", AT)
    t = first.tables

    counts = {k: n for k, n in first.counts.items() if "." in k and not k.endswith(".processed")}
    assert counts == counted(TRANSFER_CASES, "transfers") | counted(VALUATION_CASES, "player_valuations")
    assert first.records == 4 + 5 + 5 + 3

    assert transfer_set(t) == {
        ("7003", date(2021, 8, 31), "82", "83"): (125_000_000, False, "Summer 2021", "2021-2022"),
        ("7001", date(2022, 1, 9), "83", "81"): (0, False, "Winter 2022", "2021-2022"),
        ("7002", date(2020, 12, 20), "81", "82"): (None, False, "Summer 2020", "2020-2021"),
        ("7002", None, "83", "82"): (30_000_000, False, "Summer 2019", "2019-2020"),
        ("7001", None, "82", "81"): (4_000, False, "Summer 2018", "2018-2019"),
    }
    by_id = {r.transfermarkt_id: r for r in t.players.collect()}
    assert {k: (r.name, r.date_of_birth, r.position, r.position_group, r.nationality) for k, r in by_id.items()} == {
        "7001": ("Ines", date(1991, 11, 30), "Goalkeeper", "GK", "Portugal"),
        "7002": ("Juno", date(1997, 3, 3), "Left-Back", "DEF", None),
        "7003": ("Kofi", date(2001, 2, 28), "Right Winger", "FWD", "Ghana"),
        "7004": ("Unknown", None, None, None, None),
    }
    assert sorted(r.id for r in by_id.values()) == [1, 2, 3, 4]

    countries = {r.id: r for r in t.countries.collect()}
    assert {r.name: r.iso_code for r in countries.values()} == {
        "England": "ENG", "Spain": "ESP", "Other": "OTH", "France": "FRA"}
    france = next(r for r in countries.values() if r.name == "France")
    assert (france.id, france.in_scope) == (4, False)
    clubs = {r.transfermarkt_id: r for r in t.clubs.collect()}
    assert {k: countries[r.country_id].name for k, r in clubs.items()} == {
        "81": "Spain", "82": "England", "83": "Spain", "84": "France", "85": "Other"}
    assert clubs["81"].current_league_id == 2 and clubs["85"].current_league_id is None
    assert {r.name: r.transfermarkt_id for r in t.leagues.collect()} == {"Premier League": "GB1", "LaLiga": "ES1"}

    values = {(r.player_id, r.valuation_date): r.valuation_eur for r in t.player_valuations.collect()}
    assert values == {
        (by_id["7001"].id, date(2020, 12, 31)): 150_000_000,
        (by_id["7001"].id, date(2021, 6, 30)): 175_000_050,
        (by_id["7003"].id, date(2021, 12, 15)): 800_000_000,
    }
    assert t.country_transfer_flows.count() == 5
    report = {r.name: r for r in first.report.collect()}
    assert len(report) == 13
    assert report["country_flow_reconciliation"].passed and report["no_orphan_transfers"].passed
    assert not report["row_count_players"].passed

    before = transfer_set(t), ids(t.players), ids(t.clubs), values
    second = load.run_load(store, folder, "abc", AT)
    t = second.tables
    after = transfer_set(t), ids(t.players), ids(t.clubs), {
        (r.player_id, r.valuation_date): r.valuation_eur for r in t.player_valuations.collect()}
    assert before == after
    assert second.records == first.records
    for table in ("transfers", "player_valuations", "players", "clubs"):
        changes = {r.change for r in merge.change_counts(store.outcomes(table, second.version)).collect()}
        assert changes == {"unchanged"}, table

    latest = store.latest().first()
    assert (latest.records_processed, latest.source_commit_hash, latest.last_ingestion_at) == (
        17, "abc", AT.replace(tzinfo=None))
    load.log_report(second.report)


def test_reload_rules(spark, store, tmp_path):
    load.run_load(store, snapshot(tmp_path / "one"), "1", AT)
    changed = dict(
        players=[player("7001", "Ines B"), player("7001", "Ines C"), player("7009", "Lena 1"),
                 player("7009", "Lena 2")],
        clubs=[club("82", "Ironworks FC", "ES1"), club("86", "Newport County", "ES1")],
        transfers=[
            # stored fee 1.25m: the last differing row counts, though the stored value comes last
            transfer("7003", "2021-08-31", "21/22", "82", "83", "3"),
            transfer("7003", "2021-08-31", "21/22", "82", "83", "6"),
            transfer("7003", "31/08/2021", "21/22", "82", "83", "1,250,000"),
            # new key: the first row counts
            transfer("7009", "2023-06-20", "22/23", "81", "86", "9"),
            transfer("7009", "2023-06-20", "22/23", "81", "86", "11"),
            # null dates are one key
            transfer("7002", "", "19/20", "83", "82", "€300k"),
            transfer("7002", "soon", "19/20", "83", "82", "€310k"),
        ],
        player_valuations=[valuation("7001", "2020-12-31", "2500000"), valuation("7001", "2020-12-31", "1500000")],
    )
    result = load.run_load(store, snapshot(tmp_path / "two", **changed), "2", AT)
    t = result.tables
    names = {r.transfermarkt_id: r.name for r in t.players.collect()}
    assert names["7001"] == "Ines C" and names["7009"] == "Lena 1" and names["7003"] == "Kofi"
    assert ids(t.players)["7009"] == 5
    clubs = {r.transfermarkt_id: r for r in t.clubs.collect()}
    assert clubs["82"].name == "Ironworks FC" and clubs["82"].country_id == 1 and clubs["82"].current_league_id == 2
    assert clubs["86"].country_id == 1
    got = transfer_set(t)
    assert got["7003", date(2021, 8, 31), "82", "83"][0] == 600
    assert got["7009", date(2023, 6, 20), "81", "86"][0] == 900
    assert got["7002", None, "83", "82"][0] == 31_000_000
    assert len(got) == 6
    value = t.player_valuations.filter("valuation_date = '2020-12-31'").first()
    assert value.valuation_eur == 250_000_000
    outcomes = {r.change: (r.key_count, r.row_count)
                for r in merge.change_counts(store.outcomes("transfers", result.version)).collect()}
    assert outcomes == {"insert": (1, 2), "update": (2, 5), "kept": (3, 0)}
    assert result.counts["transfers.processed"] == 7


def test_codes_and_malformed_rows_of_a_load(spark, store, tmp_path):
    nations = ["Zqx", "ZQ1 land", "Zqx two", "Zqx three", "ZQ2 land"]
    folder = snapshot(tmp_path / "raw", competitions=[competition(f"Z{i}", "Cup", n) for i, n in enumerate(nations)],
                      clubs=[club(str(i), "Club", f"Z{i}") for i in range(len(nations))])
    with open(tmp_path / "raw" / "transfers.csv", "a", encoding="utf-8") as f:
        f.write("7001,2021-01-01,20/21,1,2,,,5,,,surplus\n")
        f.write('7001,2021-01-01,20/21,1,2,,,5,,"cut\nhere"\n')
    result = load.run_load(store, folder, "z", AT)
    codes = {r.name: r.iso_code for r in result.tables.countries.collect()}
    assert [codes[n] for n in nations] == ["ZQX", "ZQ1", "ZQ2", "ZQ3", "ZQ4"]
    assert result.counts["transfers.malformed_row"] >= 2

    with open(tmp_path / "raw" / "players.csv", "a", encoding="utf-8") as f:
        f.write("1,a,,,,,,surplus\n")
    with pytest.raises(Exception, match="players.csv: malformed row"):
        load.run_load(store, folder, "z", AT)
    assert store.sequence() == 2
    (tmp_path / "raw" / "clubs.csv.gz").write_bytes(b"")
    with pytest.raises(AmbiguousFileError):
        read_snapshot(spark, folder, "clubs.csv")


def test_contract(spark, tmp_path, caplog):
    write_csv(tmp_path / "transfers.csv", [{"player_id": "1", "transfer_date": ""}])
    with pytest.raises(SchemaValidationError, match="transfer_fee"):
        read_snapshot(spark, str(tmp_path), "transfers.csv")
    write_csv(tmp_path / "player_valuations.csv", [{**VALUATIONS[0], "new_upstream_field": "x"}])
    with caplog.at_level(logging.WARNING):
        rows = read_snapshot(spark, str(tmp_path), "player_valuations.csv")
    assert rows.count() == 1 and "new_upstream_field" in caplog.text
    assert "new_upstream_field" not in rows.columns
    check_columns("unknown.csv", ["a"])


def test_quoted_fields_and_gzip(spark, tmp_path):
    rows = [competition("A", 'Cup "One", x', "Côte d'Ivoire"), competition("B", "", "")]
    write_csv(tmp_path / "competitions.csv", rows)
    plain = read_snapshot(spark, str(tmp_path), "competitions.csv").drop(ORDINAL).collect()
    assert plain[0].name == 'Cup "One", x' and plain[0].country_name == "Côte d'Ivoire"
    packed = tmp_path / "gz"
    packed.mkdir()
    with open(tmp_path / "competitions.csv", "rb") as a, gzip.open(packed / "competitions.csv.gz", "wb") as b:
        shutil.copyfileobj(a, b)
    assert read_snapshot(spark, str(packed), "competitions.csv", partitions=4).drop(ORDINAL).count() == 2


def test_ordinal_follows_files(spark, tmp_path):
    folder = tmp_path / "competitions.csv"
    folder.mkdir()
    for part in range(3):
        write_csv(folder / f"part-{part}.csv",
                  [competition(f"{part}-{i:03d}", "n", "c") for i in range(200)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = read_csv(spark, str(folder), "competitions.csv")
        assert rows.rdd.getNumPartitions() > 3
        ordered = [r.competition_id for r in rows.orderBy(ORDINAL).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered == [f"{p}-{i:03d}" for p in range(3) for i in range(200)]


def test_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    assert store.read_current("players").count() == 0 and store.latest().count() == 0
    load.seed(store, AT)
    assert store.read_current("countries").count() == 13 and store.read_current("leagues").count() == 15
    twice = seeds.seed_countries(spark).unionByName(seeds.seed_countries(spark))
    store.write("countries", "bad", twice)
    with pytest.raises(DuplicateKeyError):
        store.publish({"countries": "bad"}, 0, None, AT)
    assert store.read_current("countries").count() == 13
    renamed = seeds.seed_countries(spark).withColumn("iso_code", F.lit("SAM"))
    store.write("countries", "same", renamed)
    with pytest.raises(DuplicateKeyError, match="iso_code"):
        store.publish({"countries": "same"}, 0, None, AT)
    tables = {"a": seeds.seed_leagues(spark), "b": store.read_current("countries")}
    assert {r.table_name: r.row_count for r in row_counts(tables).collect()} == {"a": 15, "b": 13}
    fresh = freshness(store.latest(), datetime(2024, 7, 16, tzinfo=timezone.utc)).first()
    assert (fresh.age_days, fresh.is_stale) == (45.0, False)
    assert freshness(store.latest(), datetime(2024, 7, 17, tzinfo=timezone.utc)).first().is_stale


def test_publish_conflicts(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    load.seed(store, AT)
    store.write("leagues", "mine", seeds.seed_leagues(spark))
    with pytest.raises(PublishConflictError, match="based on"):
        store.publish({"leagues": "mine"}, 0, None, AT, based_on=0)
    store._claim(2)  # another publisher is at work, or died
    with pytest.raises(PublishConflictError, match="left unfinished"):
        store.publish({"leagues": "mine"}, 0, None, AT, based_on=1)
    store.release(2)
    store.publish({"leagues": "mine"}, 0, None, AT, based_on=1)
    assert store.versions()["leagues"] == "mine" and store.sequence() == 2
    with pytest.raises(PublishConflictError):
        store.release(2)


def test_codes_follow_the_sequential_rule(spark, monkeypatch):
    """Codes of many names that meet, against one name after the other; small blocks."""
    from flowspark.operators import resolve
    from flowspark.sources.iso_codes import ISO_CODES

    monkeypatch.setattr(resolve, "ROWS_IN_BLOCK", 7)
    rnd = random.Random(5)
    stored = [(1, "Other", "OTH"), (2, "a", "ZQ3"), (3, "b", "ZR1"), (4, "c", "ZQA")]
    names = [f"z{rnd.choice('qr')}{rnd.choice('123456789ABC0')} {i}" for i in range(80)] + ["France"]
    taken, want = {code for _, _, code in stored}, []
    for number, name in enumerate(names, 5):
        base = ISO_CODES.get(name, name[:3].upper())
        options = [base, *[f"{base[:2]}{n}" for n in range(1, 100)]]
        want.append((number, name, next(c for c in options if c not in taken)))
        taken.add(want[-1][2])
    competitions = spark.createDataFrame([("", n, i) for i, n in enumerate(names[:50])],
                                         "competition_id string, country_name string, o int")
    clubs = spark.createDataFrame([("", n, i) for i, n in enumerate(names[50:])],
                                  "name string, country_name string, o int")
    countries = spark.createDataFrame(stored, "id int, name string, iso_code string")
    added = resolve.new_countries(spark, resolve.needed_countries(competitions, clubs, "o"), countries)
    assert [(r.id, r.name, r.iso_code) for r in added.orderBy("id").collect()] == want


def test_country_names_and_codes(spark):
    from flowspark.operators import resolve

    countries = spark.createDataFrame(
        [(1, "Brasilia", "BRA"), (2, "Bravo", "BR1"), (3, "Other", "OTH")], "id int, name string, iso_code string")
    raw = [("c0", "Brazil"), ("c1", "Korea, South"), ("c2", "United Kingdom"), ("c3", "Brandland"), ("c4", "Zed"),
           ("c5", "Zedland"), ("c6", "Cote d'Ivoire"), ("c7", "Brazil"), ("c8", "")]
    competitions = spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(raw)],
                                         "competition_id string, country_name string, o int")
    clubs = spark.createDataFrame([("x", "France", 0)], "name string, country_name string, o int")
    needed = resolve.needed_countries(competitions, clubs, "o")
    added = resolve.new_countries(spark, needed, countries)
    assert [(r.id, r.name, r.iso_code) for r in added.orderBy("id").collect()] == [
        (4, "Brazil", "BR2"), (5, "South Korea", "KOR"), (6, "Brandland", "BR3"), (7, "Zed", "ZED"),
        (8, "Zedland", "ZE1"), (9, "Ivory Coast", "CIV"), (10, "France", "FRA")]
    mapped = {r.competition_id: r.country_name
              for r in resolve.competition_countries(competitions, "o").collect()}
    assert mapped["c2"] == "Other" and mapped["c1"] == "South Korea" and "c8" not in mapped


def rebuilt_equals_stored(store, version):
    from flowspark.operators import aggregates

    transfers, clubs = store.read("transfers", version).drop("from_country_id", "to_country_id"), store.read("clubs", version)
    for table, rebuilt in (("country_transfer_flows", aggregates.country_flows_by_window(transfers, clubs)),
                           ("club_transfer_summaries", aggregates.club_summaries_by_window(transfers))):
        stored = store.read(table, version)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rebuilt.select(*stored.columns).collect())), table


def test_load_writes_only_what_changed(spark, store, tmp_path):
    """An unchanged snapshot writes nothing, a changed row its own period, aggregates follow by change."""
    one = load.run_load(store, snapshot(tmp_path / "one"), "1", AT)
    assert {p.part for p in store.parts("transfers", one.version)} == {2021 * 2, 2022 * 2 + 1, 2020 * 2, -1}
    assert one.counts["country_transfer_flows"] == 5 and one.counts["transfers"] == 5
    rebuilt_equals_stored(store, one.version)

    two = load.run_load(store, snapshot(tmp_path / "two"), "2", AT)
    for table in ("countries", "leagues", "clubs", "players", "transfers", "player_valuations",
                  "country_transfer_flows", "club_transfer_summaries"):
        assert store.written(table, two.version) == [], table
        assert store.parts(table, two.version) == store.parts(table, one.version)
    assert two.counts == one.counts and two.records == one.records

    rows = [dict(r) for r in TRANSFERS]
    rows[0]["transfer_fee"] = "€2.5m"          # a new fee in summer 2021
    rows[3]["transfer_season"] = "17/18"       # an undated transfer moves from summer 2019 to summer 2017
    rows[1:2] = []                             # winter 2022 is missing now
    rows.append(transfer("7001", "2020-08-30", "20/21", "81", "82", "7"))
    three = load.run_load(store, snapshot(tmp_path / "three", transfers=rows), "3", AT)
    assert {p.part for p in store.written("transfers", three.version)} == {2021 * 2, 2020 * 2, -1}
    assert store.written("players", three.version) == store.written("player_valuations", three.version) == []
    assert {p.part for p in store.written("country_transfer_flows", three.version)} == {4042, 4040, 4034}
    assert {p.part for p in store.parts("country_transfer_flows", three.version)} == {4042, 4045, 4040, 4034, 4036}
    assert three.counts["transfers"] == 6 and three.counts["transfers.processed"] == 5
    outcomes = {r.change: r.key_count for r in merge.change_counts(store.outcomes("transfers", three.version)).collect()}
    assert outcomes == {"insert": 1, "update": 2, "unchanged": 2, "kept": 1}
    rebuilt_equals_stored(store, three.version)
    windows = {r.transfer_window for r in three.tables.transfers.collect()}
    assert windows == {"Summer 2021", "Winter 2022", "Summer 2020", "Summer 2017", "Summer 2018"}

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    filters = TransferFilters(transfer_type="paid", country_ids=[1])
    flows = country_flows(three.tables, filters)
    pushed = [line for line in flows._jdf.queryExecution().executedPlan().toString().splitlines() if "fee_eur" in line and "FileScan" in line]
    assert len(pushed) == 1 and "from_club_id" not in pushed[0]
    assert "EqualTo(from_country_id,1)" in pushed[0].split("PushedFilters")[1]
    assert {(r.from_country_id, r.to_country_id) for r in flows.collect()} == {(1, 2), (2, 1)}
    rows = country_transfers(three.tables, 1, direction="buying")
    assert "EqualTo(to_country_id,1)" in rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")

    from datetime import timedelta

    before = transfer_set(load.current_tables(store))
    gone = store.retain(loads=1, older_than=timedelta(0))
    assert any(f.startswith(f"transfers/{one.version}/_part=4042") for f in gone)
    assert not any("_part=4045" in f for f in gone if f.startswith(("transfers", "country_transfer_flows")))
    assert f"_staging/{three.version}" in gone and f"_manifests/{two.version}" in gone
    assert transfer_set(load.current_tables(store)) == before
    assert store.retain(loads=1, older_than=timedelta(0)) == []
    assert [r.sequence for r in store.load_log().orderBy("sequence").collect()] == [1, 2, 3, 4]


def test_conflicting_rows_are_merged_again(spark, store, tmp_path):
    """Where rows of one key differ, a second load of the same file may change the stored row."""
    rows = [transfer("7003", "2021-08-31", "21/22", "82", "83", fee) for fee in ("3", "6")]
    rows.append(transfer("7001", "2022-01-09", "21/22", "83", "81", "5"))
    one = load.run_load(store, snapshot(tmp_path / "raw", transfers=rows), "1", AT)
    two = load.run_load(store, str(tmp_path / "raw"), "1", AT)
    assert [p.part for p in store.written("transfers", two.version)] == [4042]
    fees = [transfer_set(load.current_tables(store))["7003", date(2021, 8, 31), "82", "83"][0]]
    fees.append({r.fee_eur for r in store.read("transfers", one.version).filter("transfer_date < '2022-01-01'").collect()}.pop())
    assert fees == [600, 300]
    rebuilt_equals_stored(store, two.version)


def test_row_layout_serves_point_lookups(spark, tmp_path):
    """A player's rows lie in few row groups of a part, and Bloom filters tell the clubs of a row group."""
    import glob

    import pyarrow.parquet as pq

    store = TableStore(spark, str(tmp_path / "t"))
    rows = spark.range(200_000).selectExpr(
        "cast(id as string) as id", "id % 50000 as player_id", "(id * 7919) % 1000003 as from_club_id",
        "(id * 104729) % 1000003 as to_club_id", "id as fee_eur", "false as fee_is_loan",
        "'Summer 2020' as transfer_window", "4040 as window_key", "date'2020-07-01' as transfer_date", "'2020-2021' as season")
    old = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(256 * 1024))
    try:
        store.write("transfers", "v", rows)
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.set("parquet.block.size", old) if old else conf.unset("parquet.block.size")
    held, groups = 0, 0
    for f in glob.glob(str(tmp_path / "t/transfers/v/_part=4040/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(1)
            assert column.path_in_schema == "player_id"
            groups += 1
            held += column.statistics.min <= 12345 <= column.statistics.max
    assert groups >= 40 and held * 10 <= groups

    def rows_read(condition):
        found = store.read("transfers", "v").filter(condition)
        plan = found._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return found.count(), plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    rows, read = rows_read("player_id = 12345")
    assert rows == 4 and read <= 200_000 / 10
    # An id that lies within the range of every row group, but in none: only the Bloom filters tell.
    taken = {r[0] for r in store.read("transfers", "v").select("from_club_id").collect()}
    absent = next(i for i in range(500_000, 600_000) if i not in taken)
    rows, read = rows_read(f"from_club_id = {absent}")
    assert rows == 0 and read <= 200_000 / 5


def test_merge_reads_its_snapshot_once(spark):
    """Two scans of the snapshot's halves and one of the stored rows: no exchange is made twice."""
    from flowspark.checks.sample import Sample

    s = Sample(spark, "/root/testdata/sf0.001")
    merged = load.merge_transfers(s.stored_transfers, s.transfer_snapshot)
    merged.toArrow()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("FileScan parquet [l_orderkey") == 3
