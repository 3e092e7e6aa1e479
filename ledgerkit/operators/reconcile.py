"""Reconciliation: ledger and bank checks, balance walk, invariants, the review set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ledger_components(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The statement's buckets from ledger rows; payments and credits count positive."""
    s = lambda *t: F.coalesce(F.sum(F.when(F.col("type").isin(*t), F.col("cents"))), F.lit(0)).cast("long")
    return rows.groupBy(*by).agg(s("purchase").alias("purchases"), (-s("payment")).alias("payments"), (-s("refund", "credit")).alias("credits"), s("fee").alias("fees"), s("interest").alias("interest"))


def bank_ledger(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Statement totals against rows in the closed period: account, state (incomplete, match, mismatch), deltas.

    statements: account, period_start, period_end, deposits, withdrawals. Incomplete unless the rows cover the period.
    """
    span = rows.groupBy("account").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    inside = statements.alias("s").join(rows.alias("r"), [F.col("s.account") == F.col("r.account"), F.col("r.day").between(F.col("s.period_start"), F.col("s.period_end"))], "left")
    sums = inside.groupBy("s.account", "s.period_start", "s.period_end", "s.deposits", "s.withdrawals").agg(F.coalesce(F.sum(F.when(F.col("r.cents") < 0, -F.col("r.cents"))), F.lit(0)).alias("in_"), F.coalesce(F.sum(F.when(F.col("r.cents") > 0, F.col("r.cents"))), F.lit(0)).alias("out_"))
    j = sums.join(span, "account", "left").withColumn("deposits_delta", F.col("deposits") - F.col("in_")).withColumn("withdrawals_delta", F.col("withdrawals") - F.col("out_"))
    covered = (F.col("first_day") <= F.col("period_start")) & (F.col("last_day") >= F.col("period_end"))
    state = F.when(~F.coalesce(covered, F.lit(False)), "incomplete").when((F.col("deposits_delta") == 0) & (F.col("withdrawals_delta") == 0), "match").otherwise("mismatch")
    return j.select("account", "period_start", "period_end", state.alias("state"), "deposits_delta", "withdrawals_delta")


def card_ledger(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Components of statements against the rows in (start, end]: account, period_end, component, stated, found."""
    inside = statements.select("account", "period_start", "period_end").alias("s").join(rows.alias("r"), [F.col("s.account") == F.col("r.account"), F.col("r.day") > F.col("s.period_start"), F.col("r.day") <= F.col("s.period_end")])
    found = ledger_components(inside.select("s.account", "s.period_end", "r.type", "r.cents"), ["account", "period_end"])
    names = ["purchases", "payments", "credits", "fees", "interest"]
    long = lambda df, v: df.select("account", "period_end", F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).cast("long").alias(v)) for n in names])).alias("x")).select("account", "period_end", "x.*")
    both = long(statements, "stated").join(long(found, "found"), ["account", "period_end", "component"], "left")
    return both.withColumn("found", F.coalesce("found", F.lit(0))).withColumn("delta", F.col("stated") - F.col("found"))


def balance_walk(rows: DataFrame) -> DataFrame:
    """Days whose rows don't lead from one printed balance to the next: account, day, expected (cents).

    rows: account, id, day, cents (out positive), balance. A day's close must be among its printed balances;
    the walk starts from the balance with the longest agreement and starts anew after a gap.

    A close plus all that went out until then is one value along an agreement. So agreements are runs of days that print
    the same value, and each day knows from windows alone how far the best of its values holds; a fold over an account's days
    (not its rows) follows the starts.
    """
    by = Window.partitionBy("account").orderBy("day")
    days = rows.groupBy("account", "day").agg(F.sum("cents").alias("net"), F.collect_set("balance").alias("balances"))
    days = days.withColumn("i", F.row_number().over(by)).withColumn("spent", F.sum("net").over(by))
    printed = days.select("account", "i", F.explode("balances").alias("balance"), "spent").withColumn("value", F.col("balance") + F.col("spent"))
    runs = printed.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("account", "value").orderBy("i")))
    ends = runs.withColumn("end", F.max("i").over(Window.partitionBy("account", "value", "island")))
    best = ends.groupBy("account", "i").agg(F.max(F.struct("end", (-F.col("balance")).alias("low"), "value")).alias("best")).select("account", "i", "best.end", "best.value")
    known = days.join(best, ["account", "i"], "left").select("account", F.struct("i", "day", "spent", F.coalesce("end", "i").alias("end"), "value").alias("d"))
    walked = known.groupBy("account").agg(F.array_sort(F.collect_list("d")).alias("days"))
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("long").alias("value"), F.array().cast("array<struct<day:date,expected:long>>").alias("bad"))

    def step(state, day):
        gap = F.when(state["value"].isNotNull(), F.array(F.struct(day["day"].alias("day"), (state["value"] - day["spent"]).cast("long").alias("expected")))).otherwise(F.array().cast("array<struct<day:date,expected:long>>"))
        anew = F.struct(day["end"].alias("end"), day["value"].cast("long").alias("value"), F.concat(state["bad"], gap).alias("bad"))
        return F.when(day["i"] <= state["end"], state).otherwise(anew)

    bad = walked.select("account", F.explode(F.aggregate("days", start, step)["bad"]).alias("b"))
    return bad.select("account", "b.day", "b.expected")


def used_twice(links: DataFrame, key: str) -> DataFrame:
    """Violations of "each once": empty when the invariant holds."""
    return links.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def linked_but_spending(links: DataFrame, txns: DataFrame, spending: Sequence[str]) -> DataFrame:
    return txns.filter(F.col("type").isin(*spending)).join(links.select("id"), "id", "left_semi").select("id", "type")


def merge_reviews(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The review set after a run; both have kind, ref, details; stored also status (open, resolved, ignored).

    Open items seen again take the new details; open ones not seen are resolved; resolved and ignored ones
    stay as they are; new ones open.
    """
    both = stored.join(current.select("kind", "ref", F.col("details").alias("__new"), F.lit(True).alias("__seen")), ["kind", "ref"], "full")
    seen = F.coalesce("__seen", F.lit(False))
    status = F.when(F.col("status").isNull(), "open").when((F.col("status") == "open") & ~seen, "resolved").otherwise(F.col("status"))
    details = F.when(F.col("status").isNull() | ((F.col("status") == "open") & seen), F.col("__new")).otherwise(F.col("details"))
    return both.select("kind", "ref", details.alias("details"), status.alias("status"))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group by a total order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
