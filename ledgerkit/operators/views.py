"""Predicates and small aggregations behind listings: what is asked of the ledger, not how it is shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flows of checking rows that are transfers.
TRANSFER_FLOWS = ("card_payment", "card_payment_other", "own_transfer", "investment")


def flow_or_type(kinds: Sequence[str]) -> Column:
    """A row's flow is one of these; a row without flow goes by its type."""
    return F.coalesce("flow_kind", "type").isin(*kinds)


def flow_class(flow: Column, cents: Column, transfers: Sequence[str] = TRANSFER_FLOWS) -> Column:
    """Struct (type, flow_kind) of a checking row by its rule's flow; payments to people, checks and cash go by sign."""
    out = cents > 0
    pair = lambda kind, kept: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), (kept if isinstance(kept, Column) else F.lit(kept).cast("string")).alias("flow_kind"))
    by_sign = F.when(out, "purchase").otherwise("deposit")
    return (
        F.when(flow.isin(*transfers), pair("transfer", flow))
        .when(flow == "fee", pair("fee", None))
        .when(flow == "refund", pair("refund", None))
        .when(flow == "p2p", pair(by_sign, "p2p"))
        .when(flow.isin("check", "atm"), pair(by_sign, F.when(out, flow).otherwise("other_in")))
        .otherwise(pair("deposit", flow))
    )


def rewardable(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Purchases that a card could have earned on: those of cards, and those of checking accounts without a flow. accounts: account, kind."""
    return rows.join(accounts, "account").filter((F.col("type") == "purchase") & ((F.col("kind") != "checking") | F.col("flow_kind").isNull())).select(*[F.col(c) for c in rows.columns])


def from_source(prefix: str) -> Column:
    """source begins with ``prefix_``; the underscore is itself, not a wildcard."""
    return F.col("source").like(prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "\\_%")


def in_open_review(rows: DataFrame, reviews: DataFrame, of: str = "transactions") -> DataFrame:
    """Rows that an open review item refers to, by their id as text."""
    ids = reviews.filter((F.col("status") == "open") & (F.col("ref_table") == of)).select("ref_id")
    return rows.join(ids, rows["id"].cast("string") == ids["ref_id"], "left_semi")


def reviews_by_kind(reviews: DataFrame) -> DataFrame:
    return reviews.filter("status = 'open'").groupBy("kind").agg(F.count("*").alias("open"))


def category_rank(lines: DataFrame) -> DataFrame:
    """Parent categories with more out than in, by all-time cents: rank, category, cents. ``uncategorized`` has no rank."""
    sums = lines.groupBy(F.split("category", r"\.")[0].alias("category")).agg(F.sum("cents").alias("cents")).filter("cents > 0 and category <> 'uncategorized'")
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cents"), "category")))  # a row per category


def other_side(links: DataFrame, rows: DataFrame) -> DataFrame:
    """For every row of a transfer the rows on its other side: id, other_id, day, cents, method, days."""
    out = links.select(F.col("id").alias("this"), F.col("card_id").alias("other_id"), "method", "days")
    back = links.select(F.col("card_id").alias("this"), F.col("id").alias("other_id"), "method", "days")
    there = rows.select(F.col("id").alias("other_id"), "day", "cents")
    return out.unionByName(back).join(there, "other_id").select(F.col("this").alias("id"), "other_id", "day", "cents", "method", "days")


def account_status(accounts: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """accounts (account, ...) with payments, last_day, last_cents (latest by day, then id) and open_items."""
    paid = payments.groupBy("account").agg(F.count("*").alias("payments"), F.max(F.struct("day", "id", "cents")).alias("last"))
    missing = reviews.filter("kind = 'utility_missing' and status = 'open' and ref_table = 'utility_accounts'").groupBy(F.col("ref_id").alias("account")).agg(F.count("*").alias("open_items"))
    out = accounts.join(paid, "account", "left").join(missing, "account", "left")
    return out.select(*[F.col(c) for c in accounts.columns], F.coalesce("payments", F.lit(0)).alias("payments"), F.col("last.day").alias("last_day"), F.col("last.cents").alias("last_cents"), F.coalesce("open_items", F.lit(0)).alias("open_items"))


def column_totals(lines: DataFrame, column: str) -> DataFrame:
    """month, ``column``, cents, with a null ``column`` for the month's total and a null month for the column's."""
    return lines.groupingSets([["month", column], ["month"], [column], []], "month", column).agg(F.sum("cents").alias("cents"))


def first_is_new(payments: DataFrame, accounts: DataFrame, after: int = 45, around: int = 60) -> DataFrame:
    """account, first_is_new: the first payment comes ``after`` days into its source's history, or up to ``around`` days after the account began.

    payments: account, id, day, cents, history_start; accounts: account, active_from.
    """
    first = payments.filter("cents > 0").groupBy("account").agg(F.min(F.struct("day", "id", "history_start")).alias("p"))
    late = F.datediff("p.day", "p.history_start") >= after
    begun = F.datediff("p.day", "active_from").between(0, around)
    return first.join(accounts.select("account", "active_from"), "account", "left").select("account", (F.coalesce(late, F.lit(False)) | F.coalesce(begun, F.lit(False))).alias("first_is_new"))


def ranked_insights(insights: DataFrame) -> DataFrame:
    """Insights with their rank: largest impact first, then warning, notice, info, then kind, account, period."""
    severity = F.array_position(F.array(*map(F.lit, ("warning", "notice", "info"))), F.col("severity"))
    return insights.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("impact")), severity, "kind", F.col("account").asc_nulls_first(), "period")))  # a screen of rows


def renamed(diff: DataFrame, terms: str) -> DataFrame:
    """A diff (item, state, ``terms``) in which removed and added items of equal terms are one: reworded, as ``old -> new``.

    The nth removed item (by name) of some terms goes with the nth added one.
    """
    nth = F.row_number().over(Window.partitionBy("state", terms).orderBy("item"))
    some = diff.withColumn("nth", nth)
    old = some.filter((F.col("state") == "removed") & F.col(terms).isNotNull()).select(F.col("item").alias("old"), terms, "nth")
    new = some.filter((F.col("state") == "added") & F.col(terms).isNotNull()).select(F.col("item").alias("new"), terms, "nth")
    pairs = old.join(new, [terms, "nth"])
    gone = pairs.select(F.col("old").alias("item"), F.lit("removed").alias("state")).unionByName(pairs.select(F.col("new").alias("item"), F.lit("added").alias("state")))
    return diff.select("item", "state").join(gone, ["item", "state"], "left_anti").unionByName(pairs.select(F.concat_ws(" -> ", "old", "new").alias("item"), F.lit("reworded").alias("state")))


def months_before(day: Column, months: int) -> Column:
    """The same day of an earlier month, or that month's last day."""
    return F.add_months(day, -months)


def upper_median(values: Column) -> Column:
    """The middle of a sorted array; of two middles the larger."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def at_least(k: int, probabilities: Column) -> Column:
    """Probability that k or more of independent events happen: a fold that keeps the chances of 0 .. k - 1 so far."""
    start = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    # The last place is the chance of k or more: it only gains.
    step = lambda chances, p: F.transform(chances, lambda q, i: q * F.when(i == k, 1.0).otherwise(1.0 - p) + F.when(i > 0, F.get(chances, i - 1) * p).otherwise(0.0))
    return F.get(F.aggregate(probabilities, start, step), F.lit(k))
