"""Insights at their thresholds, by hand; their queries are compared with DuckDB beside all others."""

import datetime

from pyspark.sql import functions as F

from ledgerkit.operators import insights

D = datetime.date


def series(spark, rows):
    return spark.createDataFrame([(a, D(y, m, 1), f"{y}-{m:02d}", c) for a, y, m, c in rows], "account long, first date, month string, cents long")


def test_against_last_year(spark):
    pairs = {1: (10_000, 11_000), 2: (10_000, 10_999), 3: (4_000, 4_499), 4: (4_000, 4_500), 5: (0, 9_000), 6: (-500, 9_000), 7: (10_000, 9_000), 8: (10_000, 0)}
    rows = [(a, 2023, 3, old) for a, (old, _) in pairs.items()] + [(a, 2024, 3, new) for a, (_, new) in pairs.items() if new] + [(9, 2023, 4, 1), (9, 2024, 3, 9_000)]
    got = {tuple(r) for r in insights.against_last_year(series(spark, rows), F.lit("2024-03-01").cast("date")).collect()}
    assert got == {(1, 11_000, 10_000, "notice"), (4, 4_500, 4_000, "notice"), (7, 9_000, 10_000, "info"), (8, 0, 10_000, "info")}


def test_unusual(spark):
    pay = lambda account, id_, month, cents, months=1, seasonal=False, starts=False: (account, id_, D(2024, month, 3), cents, D(2024, month, 1), months, seasonal, starts)
    rows = [
        pay(1, 1, 1, 9_000, starts=True), pay(1, 2, 2, 100), pay(1, 3, 3, 130), pay(1, 4, 4, 100), pay(1, 5, 5, 260, months=2), pay(1, 6, 6, 130), pay(1, 7, 7, 200),
        pay(2, 11, 3, 260, months=2, seasonal=True), pay(2, 12, 4, 400, seasonal=True), pay(2, 13, 1, 9_000, months=2, seasonal=True),
    ]
    frame = spark.createDataFrame(rows, "account long, id long, day date, cents long, first date, months int, seasonal boolean, starts boolean")
    past = series(spark, [(2, 2023, 2, 10), (2, 2023, 3, 150), (2, 2023, 4, 50), (2, 2023, 5, 0)])
    got = {tuple(r) for r in insights.unusual(frame, past).collect()}
    # 3 and 4 have fewer than two earlier payments, or aren't above; the median before 5 is 100, a month; before 6 and 7 it is 115 and 130.
    assert got == {(5, 200, "notice"), (7, 130, "notice"), (11, 200, "notice"), (12, 50, "warning")}


def test_seasons(spark):
    flat = [(1, 2023, m, 100) for m in range(1, 13)]
    winter = [(2, 2023, m, 200 if m in (11, 12, 1, 2, 3) else 100) for m in range(1, 13)]
    even = [(3, 2023, m, 140 if m <= 5 else 100) for m in range(1, 13)]
    short = [(4, 2023, m, 500 if m < 4 else 1) for m in range(1, 12)]
    none = [(5, 2023, m, 0) for m in range(1, 13)]
    got = {tuple(r) for r in insights.seasons(series(spark, flat + winter + even + short + none)).collect()}
    assert got == {(2, "2023-11", 5882), (3, "2023-01", 5000)}
