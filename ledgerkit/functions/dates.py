"""Date columns: months, period windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def period_window(day: Column, kind: str, anniversary: Column | None = None) -> Column:
    """Struct (start, end, key) of the period that holds ``day``; both ends belong to it. A card's year without an anniversary is the calendar's."""
    if kind in ("month", "statement"):
        start = F.trunc(day, "MM")
        end, key = F.last_day(day), month(day)
    elif kind == "quarter":
        start = F.trunc(day, "QUARTER")
        end, key = F.date_sub(F.add_months(start, 3), 1), F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    elif kind == "half_year":
        half = F.when(F.month(day) <= 6, 1).otherwise(2)
        start = F.make_date(F.year(day), F.when(half == 1, 1).otherwise(7), F.lit(1))
        end, key = F.date_sub(F.add_months(start, 6), 1), F.concat(F.year(day).cast("string"), F.lit("-H"), half.cast("string"))
    elif kind == "calendar_year" or (kind == "cardmember_year" and anniversary is None):
        start = F.trunc(day, "YEAR")
        end, key = F.date_sub(F.add_months(start, 12), 1), F.year(day).cast("string")
    elif kind == "cardmember_year":
        years = F.floor(F.months_between(day, anniversary) / 12).cast("int")
        start = F.add_months(anniversary, years * 12)
        end, key = F.date_sub(F.add_months(anniversary, (years + 1) * 12), 1), F.date_format(start, "yyyy-MM-dd")
    elif kind == "multi_year":
        last = F.year(day)
        start, end = F.make_date(last - 3, F.lit(1), F.lit(1)), F.make_date(last, F.lit(12), F.lit(31))
        key = F.concat((last - 3).cast("string"), F.lit("-"), last.cast("string"))
    elif kind == "one_time":
        start, end, key = F.lit("2000-01-01").cast("date"), F.lit("2999-12-31").cast("date"), F.lit("once")
    else:
        raise ValueError(kind)
    return F.struct(start.alias("start"), end.alias("end"), key.alias("key"))


def approximate(kind: str, anniversary: Column | None = None) -> bool:
    """Whether ``period_window`` only comes near the true period: a statement's days aren't known, several years may begin with any."""
    return kind in ("statement", "multi_year") or (kind == "cardmember_year" and anniversary is None)
