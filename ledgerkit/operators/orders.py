"""Orders and the charges that paid them: three tiers of evidence for orders, receipts by their totals, and what is left to review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.stages import written
from ledgerkit.operators.matching import candidates, first_fit, greedy

#: Days from an order to the charge of its total (fixed values).
FALLBACK_DAYS = (0, 10)
EXACT, LIKELY = 1.0, 0.8


def same_card(name: Column, product: Column) -> Column:
    """An unknown name fits every card; else one name holds the other, in any case."""
    a, b = F.upper(name), F.upper(product)
    return F.coalesce(name == "", F.lit(True)) | F.coalesce(F.contains(b, a) | F.contains(a, b), F.lit(False))


def match_orders(txns: DataFrame, orders: DataFrame, charges: DataFrame, user: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """(matches, reviews) of purchases and refunds.

    txns: id, day, post_day, cents, type, order_ref, product. orders: id, ref (unique), day, total, payment. charges (the merchant's list): id, ref, day,
    cents, card. user: id, order_id of matches made by hand, which are kept and fill their orders first.

    In order of (post_day, id): a row whose order number is known takes that order; else the nearest unused charge of equal cents, on its card and within
    [low, high] days, and the order that charge names; else a purchase takes the nearest order of its cents, on its card, at most ten days back,
    that is not filled: what earlier rows have matched with it, refunds deducted, must leave room for its total.

    matches: id, order_id, charge_id, method (exact, window, charge_only), confidence. reviews: id, reason (several, no_invoice, not_imported, no_order), candidates.
    """
    rest = txns.filter(F.col("type").isin("purchase", "refund")).join(user.select("id"), "id", "left_anti")
    by_ref = orders.select(F.col("id").alias("order_id"), F.col("ref").alias("order_ref"))
    named = rest.join(by_ref, "order_ref").select("id", "order_id", F.lit(None).cast("long").alias("charge_id"))
    rest = rest.join(named.select("id"), "id", "left_anti")

    fits = same_card(F.col("r_card"), F.col("l_product"))
    listed = candidates(rest.select("id", "day", "post_day", "cents", "product"), charges, ["cents"], low, high, fits)
    listed = greedy(listed, ["l_cents"], ["l_post_day", "l_id"]).select(F.col("l_id").alias("id"), F.col("r_id").alias("charge_id"), F.col("r_ref").alias("order_ref"))
    listed = written(listed.join(by_ref, "order_ref", "left").select("id", "order_id", "charge_id", "order_ref"), "order-charges")

    exact = named.unionByName(listed.filter("order_id is not null").select("id", "order_id", "charge_id"))
    open_ = rest.join(exact.select("id"), "id", "left_anti").filter("type = 'purchase'")
    totals = orders.filter("total > 0").select("id", "day", F.col("total").alias("cents"), "payment")
    near = candidates(open_.select("id", "day", "post_day", "cents", "product"), totals, ["cents"], *FALLBACK_DAYS, same_card(F.col("r_payment"), F.col("l_product")))
    found = written(first_fit(_filled(near, exact, txns, user), ["l_post_day", "l_id"], ["step"]), "order-window")
    single, several = found.filter("ties = 1"), found.filter("ties > 1")
    window = single.select(F.col("l_id").alias("id"), F.col("r_id").alias("order_id")).join(listed.select("id", "charge_id"), "id", "left")

    undecided = several.select(F.col("l_id").alias("id"), "r_id").join(orders.select(F.col("id").alias("r_id"), "ref"), "r_id").groupBy("id").agg(F.sort_array(F.collect_list("ref")).alias("candidates"))
    alone = listed.filter("order_id is null").join(found.select(F.col("l_id").alias("id")), "id", "left_anti")
    shape = lambda df, method, confidence: df.select("id", "order_id", "charge_id", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
    matches = shape(exact, "exact", EXACT).unionByName(shape(window, "window", LIKELY)).unionByName(shape(alone, "charge_only", EXACT))

    none = F.lit(None).cast("array<string>")
    left = rest.join(matches.select("id"), "id", "left_anti").join(undecided.select("id"), "id", "left_anti")
    # A charge on the list may have told a row its order's number.
    told = left.join(listed.select("id", F.col("order_ref").alias("told")), "id", "left")
    reason = F.when(F.coalesce("order_ref", "told").isNotNull(), "not_imported").otherwise("no_order")
    reviews = undecided.select("id", F.lit("several").alias("reason"), "candidates").unionByName(alone.select("id", F.lit("no_invoice").alias("reason"), none.alias("candidates"))).unionByName(told.select("id", reason.alias("reason"), none.alias("candidates")))
    return matches, reviews


def _filled(near: DataFrame, exact: DataFrame, txns: DataFrame, user: DataFrame) -> DataFrame:
    """Candidate pairs with what matches of earlier rows have put on their order: ``filled``, and ``step``, what the pair would add."""
    rows = txns.select("id", "post_day", "cents")
    by_hand = rows.join(user.filter("order_id is not null"), "id").groupBy("order_id").agg(F.sum("cents").alias("kept"))
    earlier = rows.join(exact.select("id", "order_id"), "id").select(F.col("order_id").alias("r_id"), F.col("post_day").alias("l_post_day"), F.col("id").alias("l_id"), F.col("cents").alias("has"))
    # A pair and the matches of its order in one sequence; a sum up to each row gives what came before it.
    both = near.select("r_id", "l_post_day", "l_id", "days", F.col("l_cents").alias("step"), F.lit(0).cast("long").alias("has")).unionByName(earlier, allowMissingColumns=True)
    before = Window.partitionBy("r_id").orderBy("l_post_day", "l_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.withColumn("before", F.coalesce(F.sum("has").over(before), F.lit(0))).filter("step is not null")
    return sums.join(by_hand.withColumnRenamed("order_id", "r_id"), "r_id", "left").withColumn("filled", F.col("before") + F.coalesce("kept", F.lit(0)))


def uncharged_orders(orders: DataFrame, matches: DataFrame, today: Column, grace: int, products: Sequence[str]) -> DataFrame:
    """id of orders without any match ``grace`` days on, unless they were free or paid with a card that isn't among ``products``."""
    ours = F.array(*map(F.lit, products)) if products else F.array().cast("array<string>")
    tracked = F.col("payment").isNull() | (F.col("payment") == "") | F.exists(ours, lambda p: same_card(F.col("payment"), p))
    old = orders.filter((F.col("total") > 0) & (F.datediff(today, F.col("day")) >= grace) & tracked)
    return old.join(matches.filter("order_id is not null").select(F.col("order_id").alias("id")), "id", "left_anti").select("id")


def match_receipts(receipts: DataFrame, txns: DataFrame, user: DataFrame, today: Column, grace: int, low: int = 0, high: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, reviews, uncharged): receipts in order of (day, id) take the nearest free purchase of their total, low to high days later.

    receipts: id, day, total, payment; txns: id, day (of posting), cents, type, group; user: id of rows matched by hand. matches: id, order_id.
    reviews: id, reason: several (purchases between which a receipt can't tell, none of them taken), no_receipt (of a warehouse purchase).
    uncharged: id of receipts for which no purchase was free, ``grace`` days on, if their card is of the tracked network or unknown.
    """
    free = txns.filter("type = 'purchase'").join(user.select("id"), "id", "left_anti")
    # Receipts choose, so they are the left side: the window turns around.
    pairs = candidates(receipts.select("id", "day", F.col("total").alias("cents")), free.select("id", "day", "cents"), ["cents"], -high, -low)
    found = first_fit(pairs.withColumns({"filled": F.lit(0).cast("long"), "step": F.lit(1).cast("long")}), ["l_day", "l_id"], ["l_cents"])
    matches = found.filter("ties = 1").select(F.col("r_id").alias("id"), F.col("l_id").alias("order_id"))
    several = found.filter("ties > 1").select(F.col("r_id").alias("id"), F.lit("several").alias("reason")).distinct()
    missing = free.filter("group = 'warehouse'").join(matches.select("id"), "id", "left_anti").select("id", F.lit("no_receipt").alias("reason"))
    tracked = F.col("payment").isNull() | F.contains(F.lower("payment"), F.lit("visa"))
    uncharged = receipts.filter((F.datediff(today, F.col("day")) >= grace) & tracked).join(found.select(F.col("l_id").alias("id")), "id", "left_anti").select("id")
    return matches, several.unionByName(missing), uncharged
