"""Quality checks: a passing and a failing case each."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from flowspark.operators.aggregates import duplicate_keys
from flowspark.plans import quality
from flowspark.plans.tables import Tables

AS_OF = date(2024, 1, 1)
GOOD = dict(player_id=1, from_club_id=1, to_club_id=2, fee_eur=100_000_000, fee_is_loan=False,
            transfer_window="Summer 2023", transfer_date=date(2023, 7, 1), season="2023-2024")
SCHEMA = ("player_id long, from_club_id long, to_club_id long, fee_eur long, fee_is_loan boolean, "
          "transfer_window string, transfer_date date, season string")
CHECKS = {
    "row_count_players", "row_count_clubs", "row_count_transfers", "row_count_player_valuations",
    "no_negative_fees", "no_orphan_transfers", "no_orphan_valuations", "no_far_future_transfers",
    "no_outlier_fees", "fee_distribution_not_degenerate", "country_flow_reconciliation",
    "transfer_window_format", "position_groups_valid",
}
LIMITS = quality.Limits(players=(1, 5), clubs=(1, 5), transfers=(0, 50), player_valuations=(0, 5), distinct_fees=2)


def report(spark, transfers=(), groups=("FWD", None), valuations=(), flows=None, limits=LIMITS):
    rows = [tuple({**GOOD, **t}[k] for k in GOOD) for t in transfers]
    tables = Tables(
        countries=spark.createDataFrame([(1, True), (2, True)], "id int, in_scope boolean"),
        leagues=None,
        clubs=spark.createDataFrame([(1, 1), (2, 2)], "id long, country_id int"),
        players=spark.createDataFrame([(i + 1, g) for i, g in enumerate(groups)], "id long, position_group string"),
        transfers=spark.createDataFrame(rows, SCHEMA),
        player_valuations=spark.createDataFrame(list(valuations), "player_id long, valuation_eur long"),
        country_transfer_flows=None if flows is None else spark.createDataFrame(
            flows, "total_fee_eur long, transfer_count long, loan_count long"),
    )
    df = quality.quality_report(tables, AS_OF, limits)
    results = {r.name: r for r in df.collect()}
    assert set(results) == CHECKS
    return df, results


def test_all_pass(spark):
    df, results = report(spark, [{}, {"fee_eur": None}, {"fee_eur": 5, "fee_is_loan": True}], valuations=[(1, 5)])
    assert [n for n, r in results.items() if not r.passed] == []
    assert results["row_count_players"].message == "players: 2 rows"
    assert results["fee_distribution_not_degenerate"].details["distinct_fees"] == "2"
    assert quality.summary(df).first().asDict() == {"errors": 0, "warnings": 0, "passed": 13, "total": 13}


def test_empty_tables(spark):
    _, results = report(spark, flows=[])
    assert all(r.passed for r in results.values())
    assert results["fee_distribution_not_degenerate"].message == "No transfers to check"


@pytest.mark.parametrize("name,severity,case", [
    ("no_negative_fees", "error", dict(transfers=[{"fee_eur": -100}, {}])),
    ("no_orphan_transfers", "error", dict(transfers=[{"player_id": 999}, {"fee_eur": 1}])),
    ("no_orphan_valuations", "error", dict(transfers=[{"fee_eur": 1}, {}], valuations=[(999, 1)])),
    ("no_far_future_transfers", "warning", dict(transfers=[{"transfer_date": date(2025, 2, 4)}, {"fee_eur": 1}])),
    ("no_outlier_fees", "warning", dict(transfers=[{"fee_eur": 60_000_000_000}, {}])),
    ("fee_distribution_not_degenerate", "warning", dict(transfers=[{}] * 15)),
    ("transfer_window_format", "warning", dict(transfers=[{"transfer_window": "Q2 2023"}, {"fee_eur": 1}])),
    ("position_groups_valid", "warning", dict(transfers=[{"fee_eur": 1}, {}], groups=("WING", "GK"))),
    ("row_count_clubs", "warning", dict(transfers=[{"fee_eur": 1}, {}],
                                        limits=quality.Limits(**{**LIMITS.__dict__, "clubs": (10, 20)}))),
    ("country_flow_reconciliation", "warning", dict(transfers=[{"fee_eur": 1}, {}], flows=[(900_000_000, 2, 0)])),
])
def test_one_failure(spark, name, severity, case):
    df, results = report(spark, **case)
    assert [n for n, r in results.items() if not r.passed] == [name]
    assert results[name].severity == severity
    counts = quality.summary(df).first()
    assert (counts.errors, counts.warnings) == ((1, 0) if severity == "error" else (0, 1))


def test_messages(spark):
    _, results = report(spark, [{"transfer_window": "Q2 2023"}, {"transfer_window": None}, {"fee_eur": 1}])
    assert results["transfer_window_format"].message == "2 windows of another form: Q2 2023, null"
    _, results = report(spark, [{}, {"fee_eur": 3}], flows=[])
    aggregate = results["country_flow_reconciliation"]
    assert (aggregate.severity, aggregate.passed) == ("info", True)


def test_future_limit_is_inclusive(spark):
    _, results = report(spark, [{"transfer_date": date(2024, 6, 29)}, {"fee_eur": 1}])
    assert results["no_far_future_transfers"].passed


def test_bad_windows_and_duplicates(spark):
    df = spark.createDataFrame([("Summer 2023",), ("Summer 23",), ("winter 2023",), (None,), ("Summer 2023",)], "transfer_window string")
    assert {r[0] for r in quality.bad_windows(df).collect()} == {"Summer 23", "winter 2023", None}
    assert [tuple(r) for r in duplicate_keys(df, ["transfer_window"]).collect()] == [("Summer 2023", 2)]
    rows = df.select(F.lit(None).cast("long").alias("player_id"))
    assert quality.orphans(rows, spark.range(1)).first().row_count == 5


def test_report_reads_transfers_twice_and_valuations_once(spark, tmp_path):
    from flowspark.checks.sample import Sample

    s = Sample(spark, "/root/testdata/sf0.001")
    s.transfers.write.parquet(f"{tmp_path}/transfers")
    s.player_valuations.write.parquet(f"{tmp_path}/valuations")
    s.tables.with_aggregates().country_transfer_flows.write.parquet(f"{tmp_path}/flows")
    tables = Tables(s.countries, s.leagues, s.clubs, s.players, spark.read.parquet(f"{tmp_path}/transfers"),
                    spark.read.parquet(f"{tmp_path}/valuations"), spark.read.parquet(f"{tmp_path}/flows"))
    df = quality.quality_report(tables, AS_OF)
    assert df.count() == 13
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    reads = [line for line in final.splitlines() if "FileScan" in line]
    assert sum("transfer_window#" in line for line in reads) == 2
    assert sum(re.search(r"parquet \[player_id#\d+L\]", line) is not None for line in reads) == 1
