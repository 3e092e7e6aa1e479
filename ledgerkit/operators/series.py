"""Monthly bill series: placement, cadence, baselines, changes, seasons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.dates import month
from ledgerkit.functions.money import even_spread, half_even


def place(payments: DataFrame) -> DataFrame:
    """Payments (account, id, day, cents, covers, ahead) spread over the months they cover: backward, or forward if paid ahead; refunds stay."""
    covers = F.when(F.col("cents") < 0, 1).otherwise(F.greatest("covers", F.lit(1)))
    parts = payments.withColumn("__c", covers).select("account", "id", "day", "ahead", "__c", F.posexplode(even_spread(F.col("cents"), F.col("__c"))).alias("i", "part"))
    shift = F.when(F.col("ahead"), F.col("i")).otherwise(F.col("i") - F.col("__c") + 1)
    return parts.select("account", "id", month(F.add_months(F.trunc("day", "MM"), shift.cast("int"))).alias("month"), F.col("part").alias("cents"))


def spine(rows: DataFrame) -> DataFrame:
    """account, month for every month between an account's first and last day."""
    span = rows.groupBy("account").agg(F.trunc(F.min("day"), "MM").alias("a"), F.trunc(F.max("day"), "MM").alias("b"))
    return span.select("account", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("first"))


def monthly(rows: DataFrame) -> DataFrame:
    """account, month, cents with 0 for months without a row."""
    sums = rows.groupBy("account", F.trunc("day", "MM").alias("first")).agg(F.sum("cents").alias("cents"))
    return spine(rows).join(sums, ["account", "first"], "left").select("account", "first", month(F.col("first")).alias("month"), F.coalesce("cents", F.lit(0)).cast("long").alias("cents"))


def cadence(payments: DataFrame, default: int = 30) -> DataFrame:
    """account, last_day, median gap in days between the last six positive payments (half-even), next_day."""
    w = Window.partitionBy("account").orderBy("day", "id")
    last = payments.filter("cents > 0").withColumn("gap", F.datediff("day", F.lag("day").over(w))).withColumn("__n", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("day"), F.desc("id")))).filter("__n <= 6")
    # Six payments have five gaps; the gap before the sixth lies outside.
    g = last.groupBy("account").agg(F.max("day").alias("last_day"), F.median(F.when(F.col("__n") <= 5, F.col("gap"))).alias("m"))
    gap = F.coalesce(half_even(F.col("m")), F.lit(default)).cast("int")
    return g.select("account", "last_day", gap.alias("gap"), F.date_add("last_day", gap).alias("next_day"))


def missing_bills(cadences: DataFrame, today, grace: int = 10) -> DataFrame:
    return cadences.filter(F.datediff(today, F.col("next_day")) > grace)


def baseline(payments: DataFrame, n: int = 6) -> DataFrame:
    """Each payment with the median (half-even) of up to n payments before it (two at least), and whether it is 1.3 times that."""
    w = Window.partitionBy("account").orderBy("day", "id").rowsBetween(-n, -1)
    before = F.array_sort(F.collect_list("cents").over(w))
    size = F.size("b")
    middle = (F.get("b", ((size - 1) / 2).cast("int")) + F.get("b", (size / 2).cast("int"))) / 2
    rows = payments.withColumn("b", before).withColumn("typical", F.when(F.size("b") >= 2, half_even(middle)))
    return rows.withColumn("unusual", F.coalesce(F.col("cents") * 10 >= F.col("typical") * 13, F.lit(False))).drop("b")


def year_over_year(series: DataFrame) -> DataFrame:
    """Months of a series without gaps with their value a calendar year before; null where that month isn't in the series."""
    w = Window.partitionBy("account").orderBy("first")
    rows = series.withColumn("before", F.lag("cents", 12).over(w))
    return rows.select("account", "month", "cents", "before", (F.col("cents") - F.col("before")).alias("change"))


def double_payments(payments: DataFrame, days: int = 7) -> DataFrame:
    """Pairs of equal payments of an account within ``days``."""
    a, b = payments.alias("a"), payments.alias("b")
    later = (F.col("a.day") < F.col("b.day")) | ((F.col("a.day") == F.col("b.day")) & (F.col("a.id") < F.col("b.id")))
    on = [F.col("a.account") == F.col("b.account"), F.col("a.cents") == F.col("b.cents"), later, F.datediff("b.day", "a.day") <= days]
    return a.join(b, on).select(F.col("a.account").alias("account"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.cents").alias("cents"), F.datediff("b.day", "a.day").alias("apart"))


def budget_plans(series: DataFrame, least: int = 4) -> DataFrame:
    """Runs of equal paid months at the end of a series that are at least so long: gaps and islands."""
    w = Window.partitionBy("account").orderBy("first")
    change = F.when(F.col("cents") == F.lag("cents").over(w), 0).otherwise(1)
    island = series.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w))
    runs = island.groupBy("account", "__i").agg(F.min("month").alias("from_month"), F.max("month").alias("to_month"), F.count("*").alias("months"), F.first("cents").alias("cents"))
    last = runs.withColumn("__n", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("to_month")))).filter("__n = 1")
    return last.filter((F.col("months") >= least) & (F.col("cents") > 0)).select("account", "from_month", "to_month", "months", "cents")


def trailing_sum(series: DataFrame, n: int = 12) -> DataFrame:
    """Sum of n months up to each; null until there are n."""
    w = Window.partitionBy("account").orderBy("first").rowsBetween(1 - n, 0)
    return series.withColumn("months", F.count("*").over(w)).withColumn("sum", F.when(F.col("months") == n, F.sum("cents").over(w))).select("account", "month", "cents", "sum")


def season(series: DataFrame, width: int = 5) -> DataFrame:
    """The best ``width`` months in a row on the ring of an account's last 12: account, start month, cents, total; the first maximum wins."""
    w = Window.partitionBy("account").orderBy(F.desc("first"))
    last = series.withColumn("__n", F.row_number().over(w)).filter("__n <= 12").withColumn("i", 12 - F.col("__n"))
    full = last.groupBy("account").agg(F.count("*").alias("n"), F.sum("cents").alias("total")).filter("n = 12")
    ring = last.select("account", "month", "cents", F.explode(F.array(F.col("i"), F.col("i") + 12)).alias("i"))
    frame = Window.partitionBy("account").orderBy("i").rowsBetween(0, width - 1)
    sums = ring.withColumn("share", F.sum("cents").over(frame)).filter("i < 12")
    best = sums.withColumn("__n", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("share"), "i"))).filter("__n = 1")
    return best.join(full, "account").select("account", F.col("month").alias("start_month"), F.col("share").alias("cents"), "total")


def provider_switches(payments: DataFrame, days: int = 45) -> DataFrame:
    """Accounts of one service of which one ends within ``days`` of the other's beginning. payments have service."""
    span = payments.groupBy("service", "account").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    a, b = span.alias("a"), span.alias("b")
    on = [F.col("a.service") == F.col("b.service"), F.col("a.account") != F.col("b.account"), F.abs(F.datediff("b.first_day", "a.last_day")) <= days, F.col("a.first_day") < F.col("b.first_day")]
    return a.join(b, on).select(F.col("a.service").alias("service"), F.col("a.account").alias("old_account"), F.col("b.account").alias("new_account"))


def fix_drift(placed: DataFrame) -> DataFrame:
    """Monthly accounts: of a month with two payments and an empty neighbour the earliest moves back, else the latest forward, from left to right.

    placed: account, id, first (month), day, cents. Refunds and payments over several months stay. A month that moves
    one back asks whether the month two before has filled that neighbour; so months of like parity form chains, along
    which the last month that doesn't depend on its predecessor decides.
    """
    number = F.year("first") * 12 + F.month("first") - 1
    rows = placed.withColumn("at", number).withColumn("movable", (F.col("cents") > 0) & (F.count("*").over(Window.partitionBy("account", "id")) == 1))
    w = Window.partitionBy("account").orderBy("at")
    months = rows.filter("movable").groupBy("account", "at").agg(F.count("*").alias("n"), F.min(F.struct("day", "id"))["id"].alias("early"), F.max(F.struct("day", "id"))["id"].alias("late"))
    two = F.col("n") >= 2
    back = two & (F.lag("at").over(w) < F.col("at") - 1)  # there is an earlier month, and the one before is empty
    ahead = two & (F.lead("at").over(w) > F.col("at") + 1)
    chain = Window.partitionBy("account", F.col("at") % 2).orderBy("at")
    months = months.withColumn("back", F.coalesce(back, F.lit(False))).withColumn("ahead", F.coalesce(ahead, F.lit(False)))
    follows = F.coalesce(F.lag("at").over(chain) == F.col("at") - 2, F.lit(False))
    fixed = F.when(~F.col("ahead"), False).when(~F.col("back"), True).when(~follows, False)
    goes_ahead = F.last("fixed", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    months = months.withColumn("fixed", fixed).withColumn("goes_ahead", goes_ahead).withColumn("goes_back", F.col("back") & ~F.col("goes_ahead") & ~(follows & F.coalesce(F.lag("goes_ahead").over(chain), F.lit(False))))
    moves = months.filter("goes_ahead or goes_back").select("account", F.when(F.col("goes_back"), F.col("early")).otherwise(F.col("late")).alias("id"), F.when(F.col("goes_back"), -1).otherwise(1).alias("by"))
    out = rows.join(moves, ["account", "id"], "left").withColumn("at", F.col("at") + F.coalesce("by", F.lit(0)))
    name = F.format_string("%04d-%02d", F.floor(F.col("at") / 12).cast("int"), (F.col("at") % 12 + 1).cast("int"))
    return out.select("account", "id", name.alias("month"), "cents")


def flat_steps(payments: DataFrame, hold: int = 2, tolerance: int = 100, baseline: int = 6) -> DataFrame:
    """The latest change of a flat bill whose new level held ``hold`` payments: account, day, old and new cents.

    The levels are medians: of the payments that hold the new one, and of those among the ``baseline`` before
    that hold the old one (of all of these, if fewer than ``hold`` do).
    """

    def held(values: np.ndarray) -> np.ndarray:
        """The payments before the first that leaves the level of the first."""
        left = np.abs(values - values[0]) >= tolerance
        return values[: int(left.argmax())] if left.any() else values

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "id"])
        cents = pdf["cents"].to_numpy()
        found = []
        for i in (np.flatnonzero(np.abs(np.diff(cents)) >= tolerance) + 1)[::-1]:
            after, before = held(cents[i:]), cents[max(0, i - baseline) : i][::-1]
            level = held(before)
            old, new = (round(float(np.median(x))) for x in (level if len(level) >= hold else before, after))
            if len(after) >= hold and abs(new - old) >= tolerance:
                found = [(pdf["account"].iloc[0], pdf["day"].iloc[i], old, new)]
                break
        return pd.DataFrame(found, columns=["account", "day", "old_cents", "new_cents"])

    return payments.filter("cents > 0").groupBy("account").applyInPandas(find, "account long, day date, old_cents long, new_cents long")
