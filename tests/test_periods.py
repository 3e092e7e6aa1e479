"""The kinds of periods that have no other test."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerkit.functions import dates

D = datetime.date


@pytest.mark.parametrize(
    "kind, want",
    [
        ("statement", (D(2026, 2, 1), D(2026, 2, 28), "2026-02")),
        ("multi_year", (D(2023, 1, 1), D(2026, 12, 31), "2023-2026")),
        ("one_time", (D(2000, 1, 1), D(2999, 12, 31), "once")),
        ("cardmember_year", (D(2026, 1, 1), D(2026, 12, 31), "2026")),
    ],
)
def test_period(spark, kind, want):
    assert tuple(spark.range(1).select(dates.period_window(F.lit("2026-02-14").cast("date"), kind).alias("x")).first().x) == want


def test_approximate(spark):
    told = F.lit("2020-05-10").cast("date")
    assert [k for k in ("month", "statement", "quarter", "half_year", "calendar_year", "multi_year", "one_time", "cardmember_year") if dates.approximate(k)] == ["statement", "multi_year", "cardmember_year"]
    assert not dates.approximate("cardmember_year", told)


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        dates.period_window(F.lit("2026-02-14").cast("date"), "week")
