"""Checks of whole tables: digests that don't depend on row order, snapshots of figures, and rules that links must keep.

Every check is a table of breaches, empty when the rule holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.operators.matching import candidates

#: Types that spend, and types that only cards have (fixed values).
SPENDING = ("purchase", "refund", "fee", "interest", "adjustment")
CARD_ONLY = ("payment", "credit", "reward", "interest", "adjustment")


def digest(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n, digest): equal for tables of the same rows, in whatever order and however often each stands there.

    Each row's SHA-256 counts as four numbers of 64 bits; their sums, and the count, tell tables apart. Sums combine before the shuffle.
    """
    names = sorted(columns or table.columns)
    plain = lambda c: F.coalesce(F.concat(F.lit("="), F.to_json(F.struct(F.col(f"`{c}`").alias("v")))), F.lit("-"))
    hexed = F.sha2(F.concat_ws("\n", *[plain(c) for c in names]), 256)
    number = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = table.select(hexed.alias("h")).agg(F.count("*").alias("n"), *[F.sum(number(i)).alias(f"p{i}") for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("")) for i in range(4)]), 256).alias("digest"))


def figures(txns: DataFrame, by: Sequence[str], spending: Sequence[str] = SPENDING) -> DataFrame:
    """kind, key, n, cents: counts and sums of spending rows by each of ``by``, and of all rows by month and type. txns: day, type, cents and ``by``."""
    month = F.date_format("day", "yyyy-MM")
    rows = txns.withColumn("month", month)
    each = F.array(*[F.struct(F.lit(b).alias("kind"), F.coalesce(F.col(b).cast("string"), F.lit("")).alias("key")) for b in ["month", *by]])
    spent = rows.filter(F.col("type").isin(*spending)).select(F.explode(each).alias("k"), "cents")
    types = rows.select(F.struct(F.lit("month|type").alias("kind"), F.concat_ws("|", "month", "type").alias("key")).alias("k"), "cents")
    return spent.unionByName(types).groupBy("k").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select("k.kind", "k.key", "n", "cents")


def changed_figures(then: DataFrame, now: DataFrame) -> DataFrame:
    """kind, key, and both sides' n and cents, of figures that differ or that one side lacks."""
    a, b = (df.select("kind", "key", F.struct("n", "cents").alias(side)) for df, side in ((then, "then"), (now, "now")))
    return a.join(b, ["kind", "key"], "full").filter(~F.col("then").eqNullSafe(F.col("now"))).select("kind", "key", F.col("then.n").alias("n_then"), F.col("then.cents").alias("cents_then"), F.col("now.n").alias("n_now"), F.col("now.cents").alias("cents_now"))


def transfer_breaches(bank: DataFrame, payments: DataFrame, links: DataFrame, low: int, high: int) -> DataFrame:
    """rule, id: breaches of the four rules of transfers.

    bank: id, day, cents, type, settled (typed by hand or by a rule, or of a kind that is never a card payment); payments: id, day, cents of card payments (in, so
    negative); links: id, card_id. 1: a linked row doesn't spend. 2: a card payment is linked once. 3: no free purchase has an unlinked card payment's amount in
    [low, high] days. 4: no checking row has a type that only cards have.
    """
    rule = lambda df, n: df.select(F.lit(n).alias("rule"), F.col("id").cast("long").alias("id"))
    spends = bank.filter(F.col("type").isin(*SPENDING)).join(links.select("id").distinct(), "id", "left_semi")
    twice = links.groupBy("card_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("card_id").alias("id"))
    free = payments.join(links.select(F.col("card_id").alias("id")), "id", "left_anti").select("id", "day", (-F.col("cents")).alias("cents"))
    open_ = bank.filter("type = 'purchase' and not coalesce(settled, false)").select("id", "day", "cents")
    clash = candidates(open_, free, ["cents"], low, high).select(F.col("l_id").alias("id")).distinct()
    wrong = bank.filter(F.col("type").isin(*CARD_ONLY))
    return rule(spends, 1).unionByName(rule(twice, 2)).unionByName(rule(clash, 3)).unionByName(rule(wrong, 4))


def link_breaches(links: DataFrame, txns: DataFrame, series: DataFrame) -> DataFrame:
    """rule, id: payments linked to more than one account (1), links to rows that are no purchase or refund (2), accounts whose series don't add up to their payments (3).

    links: id, account; txns: id, cents, type; series: account, cents (a row for each month).
    """
    rule = lambda df, n: df.select(F.lit(n).alias("rule"), F.col("id").cast("long").alias("id"))
    more = links.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    paid = links.join(txns, "id")
    wrong = paid.filter(~F.col("type").isin("purchase", "refund"))
    sums = paid.groupBy("account").agg(F.sum("cents").alias("paid")).join(series.groupBy("account").agg(F.sum("cents").alias("shown")), "account", "full")
    off = sums.filter(~F.coalesce("paid", F.lit(0)).eqNullSafe(F.coalesce("shown", F.lit(0)))).select(F.col("account").alias("id"))
    return rule(more, 1).unionByName(rule(wrong, 2)).unionByName(rule(off, 3))


def unexpected_purchases(txns: DataFrame, expected: DataFrame) -> DataFrame:
    """id, card of purchases whose group their card doesn't expect: cards that expect nothing take all; a group fits a family (``store`` holds ``store_gas``).

    txns: id, card, type, group; expected: card, groups.
    """
    g = F.col("group")
    fits = F.coalesce(F.exists("groups", lambda e: (g == e) | g.startswith(F.concat(e, F.lit("_")))), F.lit(False))
    return txns.filter("type = 'purchase'").join(expected.filter("size(groups) > 0"), "card").filter(~fits).select("id", "card")


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, by their digests."""
    return digest(a).first().digest == digest(b, a.columns).first().digest
