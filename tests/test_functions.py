"""Normalisation rules against tables of cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from flowspark.functions import money, people, seasons, text
from flowspark.functions.ids import transfer_row_id

FEES = [
    # text, cents, loan, excluded
    (None, None, False, False),
    ("", None, False, False),
    ("   ", None, False, False),
    ("NA", None, False, False),
    ("End of loan", None, False, True),
    ("End of loan 30/06/2020", None, False, True),
    ("loan transfer", 0, True, False),
    ("Loan", 0, True, False),
    ("Loan fee:€1.50m", 150_000_000, True, False),
    ("Loan fee: 500k", 50_000_000, True, False),
    ("Loan fee:€1,500,000", None, True, False),
    ("Loan fee: ?", 0, True, False),
    ("loan 5m", 0, True, False),
    ("free transfer", 0, False, False),
    ("Free", 0, False, False),
    ("-", None, False, False),
    ("?", None, False, False),
    ("€25m", 2_500_000_000, False, False),
    ("€1.5M", 150_000_000, False, False),
    ("€500k", 50_000_000, False, False),
    ("€500Th.", 50_000_000, False, False),
    ("2 mil.", 200_000_000, False, False),
    ("€ 3,5 m", 350_000_000, False, False),
    (" €3m ", 300_000_000, False, False),
    ("£7", 700, False, False),
    ("50000000.000", 5_000_000_000, False, False),
    ("0.000", 0, False, False),
    ("1,500,000", 150_000_000, False, False),
    ("€1,500", 150, False, False),
    ("-500", 50_000, False, False),
    ("-1,500,000", -150_000_000, False, False),
    ("1,500,000d", None, False, False),
    ("draft", None, False, False),
    ("nan", None, False, False),
    ("-1.#IND", None, False, False),
    ("12.", 1200, False, False),
    (".5m", 50_000_000, False, False),
    ("..", None, False, False),
    ("infinity", None, False, False),
    ("19.99", 1998, False, False),
]


def test_fees(spark):
    df = spark.createDataFrame([(i, f[0]) for i, f in enumerate(FEES)], "i int, t string")
    rows = money.with_fee(df, "t").orderBy("i").collect()
    got = [(FEES[r.i][0], r.fee_eur, r.fee_is_loan, r.fee_excluded) for r in rows]
    assert got == FEES


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_seasons(spark, ansi):
    cases = [
        ("23/24", "2023-2024", 2023),
        ("23-24", "2023-2024", 2023),
        ("2023/2024", "2023-2024", 2023),
        (" 98/99 ", "1998-1999", 1998),
        ("79/80", "2079-1980", 2079),
        ("99/00", "1999-2000", 1999),
        ("1999/2000 x", "1999-2000", 1999),
        ("023/24", "23-2024", 23),
        ("23/x", None, 2023),
        ("2023", None, None),
        ("", None, None),
        (None, None, None),
    ]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
        rows = df.select(
            "i",
            seasons.normalize_season(F.col("s")).alias("n"),
            seasons.season_start_year(F.col("s")).alias("y"),
        ).collect()
        staged = {r.i: r.season for r in seasons.with_season(df, "s").collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert {r.i: (r.n, r.y) for r in rows} == {i: c[1:] for i, c in enumerate(cases)}
    assert staged == {i: c[1] for i, c in enumerate(cases)}


def test_windows(spark):
    cases = [
        (date(2023, 7, 1), "23/24", "Summer 2023"),
        (date(2023, 12, 31), None, "Summer 2023"),
        (date(2024, 1, 1), None, "Winter 2024"),
        (date(2024, 5, 31), "x", "Winter 2024"),
        (date(2024, 6, 1), "x", "Summer 2024"),
        (None, "22/23", "Summer 2022"),
        (None, "22/x", "Summer 2022"),
        (None, "000/01", None),
        (None, "2022", None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, d date, s string")
    rows = df.select("i", seasons.derive_window(F.col("d"), F.col("s")).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: c[2] for i, c in enumerate(cases)}


def test_window_keys(spark):
    labels = ["Winter 2024", "Summer 2024", "Summer 2023", "Q2 2023", "Summer  2023 x", None]
    df = spark.createDataFrame([(x,) for x in labels], "w string")
    label = [r[0] for r in df.select(seasons.window_key(F.col("w"))).collect()]
    assert label == [4049, 4048, 4046, 0, 4046, 0]
    calendar = [r[0] for r in df.select(seasons.window_key(F.col("w"), "calendar")).collect()]
    assert calendar == [4048, 4049, 4047, 0, 4047, 0]
    with pytest.raises(ValueError):
        seasons.window_key(F.col("w"), "other")


def test_id_text(spark):
    cases = {"100": "100", "100.0": "100", " 7 ": "7", "": None, "NaN": None, None: None,
             "9007199254740993": "9007199254740993", "abc": None, "1e3": "1000", "1e+05": "100000",
             "007": "7", "0": "0", "+5.": "5", "None": None, "1.2.3": None, "nan": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    rows = df.select("v", text.id_text(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases


def test_dates(spark):
    cases = {"2023-07-01": date(2023, 7, 1), "2023-07-01 10:00:00": date(2023, 7, 1),
             "": None, "soon": None, "2023-02-30": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    rows = df.select("v", text.parse_date(F.col("v")).alias("d")).collect()
    assert {r.v: r.d for r in rows} == cases


def test_ages(spark):
    cases = [
        (date(2000, 2, 29), date(2023, 2, 28), 22),
        (date(2000, 2, 29), date(2023, 3, 1), 23),
        (date(2000, 7, 1), date(2023, 7, 1), 23),
        (date(2000, 7, 1), date(2023, 6, 30), 22),
        (date(2000, 7, 1), date(2000, 6, 1), 0),
        (date(2000, 7, 1), date(1998, 6, 1), -2),
        (None, date(1998, 6, 1), None),
        (date(2000, 7, 1), None, None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, b date, d date")
    rows = df.select("i", people.age_at(F.col("d"), F.col("b")).alias("a")).collect()
    assert {r.i: r.a for r in rows} == {i: c[2] for i, c in enumerate(cases)}


def test_current_age_and_position(spark):
    df = spark.createDataFrame([(date(2000, 1, 1), " Attack "), (None, "wing")], "b date, p string")
    rows = df.select(
        people.current_age(F.col("b"), F.lit(date(2024, 1, 1))).alias("a"),
        people.position_group(F.col("p")).alias("g"),
    ).collect()
    assert [tuple(r) for r in rows] == [(24, "FWD"), (None, None)]


def test_transfer_row_id(spark):
    df = spark.createDataFrame([(1, date(2023, 7, 1), 2, 3), (1, None, 2, 3)], "p long, d date, f long, t long")
    rows = df.select(transfer_row_id(F.col("p"), F.col("d"), F.col("f"), F.col("t"))).collect()
    from hashlib import sha256

    keys = ["1:2023-07-01:2:3", "1:unknown:2:3"]
    assert [r[0] for r in rows] == [sha256(k.encode()).hexdigest()[:16] for k in keys]


def test_event_year(spark):
    df = spark.createDataFrame([(date(2023, 7, 1), "2019-2020"), (None, "2019-2020")], "d date, s string")
    assert [r[0] for r in df.select(seasons.event_year(F.col("d"), F.col("s"))).collect()] == ["2023", "2019"]


def test_dates(spark):
    from flowspark.functions.text import parse_date

    day = date(2023, 7, 2)
    cases = {
        "2023-07-02": day, "2023-07-02 10:00:00": day, "2023-07-02T10:00:00": day, "07/02/2023": day,
        "7/2/2023 9:30": day, "2023/07/02": day, "20230702": day, "Jul 2, 2023": day, "July 2, 2023": day,
        "2 jul 2023": day, "02-JUL-2023": day, "7-2-2023": day, "13/02/2023": date(2023, 2, 13),
        "Sept 3, 2021": date(2021, 9, 3), "soon": None, "": None, "2023-13-01": None, "31/31/2023": None,
        "Feb 30, 2021": None, "Jum 1, 2021": None, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", parse_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == cases
