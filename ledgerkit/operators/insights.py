"""What stands out in household accounts: against last year, against the usual payment, by season. Each rule has its thresholds; amounts are cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.money import half_even
from ledgerkit.operators.series import season

#: A change counts from a tenth of last year's value and five dollars on; a payment is unusual from 1.3 times the usual on, a warning from twice on (fixed values).
YEAR_CHANGE, YEAR_CENTS, OUTLIER, WARNING, BASELINE, SEASON_SHARE = 1_000, 500, 13_000, 20_000, 6, 5_000
_WHOLE = 10_000


def against_last_year(series: DataFrame, month: Column, least_change: int = YEAR_CHANGE, least_cents: int = YEAR_CENTS) -> DataFrame:
    """account, cents, before, level of accounts whose ``month`` (its first day) differs enough from the same month a year before.

    series: account, first, cents, without gaps. Last year's month must be in the series and above zero; a month that the series has no longer
    counts as 0. ``least_change`` is in hundredths of a per cent. level is notice for more, info for less.
    """
    last = F.add_months(month, -12)
    found = series.groupBy("account").agg(F.min("first").alias("begins"), F.coalesce(F.sum(F.when(F.col("first") == month, F.col("cents"))), F.lit(0)).alias("cents"), F.sum(F.when(F.col("first") == last, F.col("cents"))).alias("before"))
    apart = F.abs(F.col("cents") - F.col("before"))
    rows = found.filter((F.col("begins") <= last) & (F.col("before") > 0) & (apart * _WHOLE >= F.col("before") * least_change) & (apart >= least_cents))
    return rows.select("account", "cents", "before", F.when(F.col("cents") > F.col("before"), "notice").otherwise("info").alias("level"))


def unusual(payments: DataFrame, series: DataFrame, ratio: int = OUTLIER, n: int = BASELINE) -> DataFrame:
    """id, usual, level of payments that are ``ratio`` (in ten thousandths) times the usual or more.

    payments: account, id, day, cents (positive), first (first day of the month it is for), months (it covers), seasonal, starts (the account's first
    payment if that began the account: never judged and no measure for others). The usual is, of a seasonal account, what the same months
    cost a year before, if the series reaches back so far; else the median of up to n earlier payments a month, two at least, times the months covered.
    """
    own = payments.filter("not starts")
    per = half_even(F.col("cents") / F.col("months"))
    w = Window.partitionBy("account").orderBy("day", "id").rowsBetween(-n, -1)
    flat = own.withColumn("per", per).withColumn("b", F.array_sort(F.collect_list("per").over(w)))
    middle = (F.get("b", ((F.size("b") - 1) / 2).cast("int")) + F.get("b", (F.size("b") / 2).cast("int"))) / 2
    flat = flat.filter("not seasonal and size(b) >= 2").select("id", "cents", (half_even(middle) * F.col("months")).alias("usual"))
    asked = own.filter("seasonal").select("account", "id", "cents", "first", F.explode(F.transform(F.sequence(F.lit(0), F.col("months") - 1), lambda i: F.add_months("first", i - 12))).alias("month"))
    shown = series.select("account", F.col("first").alias("month"), F.col("cents").alias("paid"))
    begins = series.groupBy("account").agg(F.min("first").alias("begins"))
    past = asked.join(shown, ["account", "month"], "left").groupBy("account", "id", "cents").agg(F.coalesce(F.sum("paid"), F.lit(0)).alias("usual"), F.min("month").alias("earliest"))
    past = past.join(begins, "account").filter("earliest >= begins").select("id", "cents", "usual")
    rows = flat.unionByName(past).filter((F.col("usual") > 0) & (F.col("cents") * _WHOLE >= F.col("usual") * ratio))
    return rows.select("id", F.col("usual").cast("long").alias("usual"), F.when(F.col("cents") * _WHOLE >= F.col("usual") * WARNING, "warning").otherwise("notice").alias("level"))


def seasons(series: DataFrame, least_share: int = SEASON_SHARE, width: int = 5) -> DataFrame:
    """account, start_month, share (ten thousandths) of accounts of which ``width`` months in a row of the last twelve hold ``least_share`` of the cost."""
    rows = season(series, width).filter((F.col("total") > 0) & (F.col("cents") * _WHOLE >= F.col("total") * least_share))
    return rows.select("account", "start_month", half_even(F.col("cents") * _WHOLE / F.col("total")).cast("long").alias("share"))
