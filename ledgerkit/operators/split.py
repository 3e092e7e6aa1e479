"""Splitting charges across categories, exact to the cent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.money import largest_remainder


def item_parts(txns: DataFrame, items: DataFrame) -> DataFrame:
    """(id, line_no, category, part): each transaction's cents over its items by ``max(cents - discount, 0)``, ties to the first line."""
    weighted = txns.select("id", F.col("cents").alias("total")).join(items.withColumnRenamed("order_id", "id").select("id", "line_no", "category", F.greatest(F.col("cents") - F.col("discount"), F.lit(0)).alias("weight")), "id")
    return largest_remainder(weighted, ["id"], "total", "weight", ["line_no", "category", "weight"]).select("id", "line_no", F.coalesce("category", F.lit("uncategorized")).alias("category"), "part")


def allocate(txns: DataFrame, items: DataFrame) -> DataFrame:
    """Allocations (id, category, cents) of transactions that have items: split over the items, then summed; sums of 0 cents are dropped."""
    return item_parts(txns, items).groupBy("id", "category").agg(F.sum("part").alias("cents")).filter("cents <> 0")


def allocate_matched(txns: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Allocations (id, category, cents) of matched transactions (id, order_id, cents, category_source).

    One whose category a user has set is left alone. A refund of one item goes to that item (``refund_item``), anything
    else is split over the order's items. orders: order_id, subtotal, tax.
    """
    open_ = txns.filter(~F.col("category_source").eqNullSafe("user"))
    refunds = refund_item(open_.filter("cents < 0").select("id", "order_id", "cents"), items, orders).filter("cents <> 0")
    rest = open_.join(refunds.select("id"), "id", "left_anti").select("id", "order_id", F.col("cents").alias("total"))
    weighed = items.select("order_id", "line_no", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.greatest(F.col("cents") - F.col("discount"), F.lit(0)).alias("weight"))
    parts = largest_remainder(rest.join(weighed, "order_id"), ["id"], "total", "weight", ["line_no", "category", "weight"]).groupBy("id", "category").agg(F.sum("part").alias("cents"))
    return refunds.unionByName(parts.filter("cents <> 0"))


def dominant_category(allocations: DataFrame) -> DataFrame:
    """The category of the largest part (absolute, then by name) of each transaction."""
    w = Window.partitionBy("id").orderBy(F.abs("cents").desc(), "category")
    return allocations.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("id", "category")


def refund_item(refunds: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, category, cents) of refunds (id, order_id, cents < 0) equal to one line before discounts, or to it and its share of the tax.

    The share is the line's part of the order's subtotal, rounded half up. The first such line takes the refund.
    orders: order_id, subtotal, tax; without a subtotal an order's refunds aren't matched.
    """
    lines = items.select("order_id", "line_no", "category", F.col("cents").alias("line")).join(orders.filter("subtotal <> 0").select("order_id", "subtotal", "tax"), "order_id")
    share = F.expr("line + (2 * tax * line + subtotal) div (2 * subtotal)")
    hits = refunds.join(lines.withColumn("taxed", share), "order_id").filter((-F.col("cents") == F.col("line")) | (-F.col("cents") == F.col("taxed")))
    first = hits.groupBy("id").agg(F.min_by(F.struct("category", "cents"), F.struct("line_no", "category")).alias("x"))
    return first.select("id", F.coalesce("x.category", F.lit("uncategorized")).alias("category"), "x.cents")
