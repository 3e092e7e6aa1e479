"""Spending lines, monthly summaries, cash flow, order summaries, search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.dates import month

#: Types that count as spending, and as credits (fixed values).
SPENDING = ("purchase", "refund", "fee", "interest")
CREDIT = ("credit", "reward")
UNCATEGORIZED = "uncategorized"


def spending_lines(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """A spending transaction counts by its allocations if it has any, else as one line of its own category."""
    own = F.col("own_category") if "own_category" in txns.columns else F.lit(None).cast("string")
    rows = txns.filter(F.col("type").isin(*SPENDING)).withColumn("__own", own).withColumnRenamed("cents", "__cents")
    joined = rows.join(allocations.select("id", F.col("category").alias("__cat"), F.col("cents").alias("__part")), "id", "left")
    return joined.select("id", "account", "day", month(F.col("day")).alias("month"), "grp", F.coalesce("__cat", "__own", F.lit(UNCATEGORIZED)).alias("category"), F.coalesce("__part", "__cents").alias("cents"))


def by_month_category(lines: DataFrame) -> DataFrame:
    return lines.groupBy("month", "category").agg(F.sum("cents").alias("cents"), F.count("*").alias("lines"))


def summary_sets(lines: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One pass over the lines for the total and for each dimension alone: month, dimension, key, cents."""
    sets = [["month"]] + [["month", d] for d in dimensions]
    grouped = lines.groupingSets([[F.col(c) for c in s] for s in sets], F.col("month"), *[F.col(d) for d in dimensions]).agg(F.sum("cents").alias("cents"), *[F.grouping(d).alias(f"__g_{d}") for d in dimensions])
    name, key = F.lit("total"), F.lit("all")
    for d in dimensions:
        name = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(name)
        key = F.when(F.col(f"__g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(key)
    return grouped.select("month", name.alias("dimension"), key.alias("key"), "cents")


def conditional_trend(lines: DataFrame, groups: Sequence[str], prefix: str) -> DataFrame:
    """Per month of the spine: total, in the groups, and with the group prefix."""
    span = lines.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m")).select(month(F.col("m")).alias("month"))
    sums = lines.groupBy("month").agg(F.sum("cents").alias("total"), F.sum(F.when(F.col("grp").isin(*groups), F.col("cents"))).alias("in_groups"), F.sum(F.when(F.col("grp").startswith(prefix), F.col("cents"))).alias("with_prefix"))
    return spine.join(sums, "month", "left").select("month", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "in_groups", "with_prefix")])


def cash_flow(rows: DataFrame, outside: Sequence[str]) -> DataFrame:
    """month, side (in, out, not_counted), key: sum of absolute cents, rows."""
    side = F.when(F.col("bank_type").isin(*outside), "not_counted").when(F.col("cents") > 0, "out").otherwise("in")
    return rows.groupBy(month(F.col("day")).alias("month"), side.alias("side"), F.col("bank_type").alias("key")).agg(F.sum(F.abs("cents")).alias("cents"), F.count("*").alias("rows"))


def credits_total(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per month the sum of the rows of these kinds, 0 where there are none."""
    return rows.groupBy(month(F.col("day")).alias("month")).agg(F.coalesce(F.sum(F.when(F.col("bank_type").isin(*kinds), F.col("cents"))), F.lit(0)).cast("long").alias("cents"))


def coverage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Months of two sources side by side: rows of each, and how many of the first are matched."""
    a = first.groupBy(month(F.col("day")).alias("month")).agg(F.count("*").alias("rows_a"), F.sum(F.col("matched").cast("long")).alias("matched_a"))
    b = second.groupBy(month(F.col("day")).alias("month")).agg(F.count("*").alias("rows_b"))
    return a.join(b, "month", "full").select("month", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows_a", "matched_a", "rows_b")])


def top_items(items: DataFrame, n: int = 12) -> DataFrame:
    """The n items paid most for; the first title and category by line win."""
    order = F.struct("order_id", "line_no", "cents", "title", "category")
    per = items.groupBy("sku").agg(F.min_by("title", order).alias("title"), F.min_by("category", order).alias("category"), F.sum(F.col("cents") - F.col("discount")).alias("paid"))
    return per.orderBy(F.desc("paid"), "sku").limit(n)


def nested_orders(txns: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their items as an array sorted by line."""
    lines = items.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "sku", "cents"))).alias("items"))
    return txns.join(lines.withColumnRenamed("order_id", "id"), "id", "left")


def in_months(day: str, months: Sequence[str]) -> Column:
    """``day`` in one of the months (``yyyy-MM``), as ranges of days that reach the scan; neighbouring months are one range."""
    out, numbers = F.lit(False), sorted({int(m[:4]) * 12 + int(m[5:7]) - 1 for m in months})
    first = lambda n: F.lit(f"{n // 12:04d}-{n % 12 + 1:02d}-01").cast("date")
    for i, n in enumerate(numbers):
        if i == 0 or numbers[i - 1] != n - 1:
            begin = n
        if i + 1 == len(numbers) or numbers[i + 1] != n + 1:
            out = out | ((F.col(day) >= first(begin)) & (F.col(day) < first(n + 1)))
    return out


def search(
    txns: DataFrame, months: Sequence[str] | None = None, types: Sequence[str] | None = None, account: int | None = None, direction: str | None = None, limit: int = 2000, *,
    id: int | None = None, posted: bool = False, flows: Sequence[str] | None = None, person: str | None = None, group: str | None = None,
    categories: Sequence[str] | None = None, allocations: DataFrame | None = None, reviews: DataFrame | None = None,
) -> DataFrame:
    """AND of the filters that are given; newest first, then by id; ``limit`` is the listing's page.

    ``id`` alone finds one row, whatever else is given. ``posted``: months are those of ``post_day``. ``flows``: flow kinds, or types of rows without one.
    ``categories``: a row's own or that of any of its ``allocations``, or one below; "uncategorized" is spending without a category of its own.
    ``reviews``: rows with an open one (ref_table, ref_id, status).
    """
    if id is not None:
        return txns.filter(F.col("id") == id)
    out = txns
    if months:
        out = out.filter(in_months("post_day" if posted else "day", months))
    if types:
        out = out.filter(F.col("type").isin(*types))
    if account is not None:
        out = out.filter(F.col("account") == account)
    if direction:
        out = out.filter(F.col("cents") > 0 if direction == "out" else F.col("cents") < 0)
    if flows:
        out = out.filter(F.coalesce("flow_kind", "type").isin(*flows))
    if person is not None:
        out = out.filter(F.col("person") == person)
    if group is not None:
        out = out.filter(F.col("group") == group)
    if categories:
        out = of_categories(out, categories, allocations)
    if reviews is not None:
        open_ = reviews.filter("status = 'open' and ref_table = 'transactions'").select(F.col("ref_id").try_cast("long").alias("id")).distinct()
        out = out.join(open_, "id", "left_semi")
    return out.orderBy(F.desc("day"), F.desc("id")).limit(limit)


def of_categories(txns: DataFrame, categories: Sequence[str], allocations: DataFrame | None = None) -> DataFrame:
    """Transactions in any of the categories: by own_category, or by any allocation. "uncategorized" takes spending without an own category, never payments or credits."""
    named = [c.strip() for c in categories if c.strip() and c.strip() != UNCATEGORIZED]
    wanted = lambda c: reduce(or_, [in_category(n, c) for n in named], F.lit(False))
    hit = F.coalesce(wanted("own_category"), F.lit(False))
    if any(c.strip() == UNCATEGORIZED for c in categories):
        hit = hit | (F.col("type").isin(*SPENDING) & (F.coalesce("own_category", F.lit(UNCATEGORIZED)) == UNCATEGORIZED))
    if allocations is None or not named:
        return txns.filter(hit)
    parts = allocations.filter(wanted("category")).select("id", F.lit(True).alias("__part")).distinct()
    return txns.join(parts, "id", "left").filter(hit | F.coalesce("__part", F.lit(False))).drop("__part")


def in_category(category: str, c: str = "category") -> Column:
    """The category itself or one below it."""
    return (F.col(c) == category) | F.col(c).startswith(category + ".")


def with_category(txns: DataFrame, allocations: DataFrame, category: str) -> DataFrame:
    """Transactions of which any allocation lies in the category."""
    return txns.join(allocations.filter(in_category(category)).select("id"), "id", "left_semi")


def in_families(families: Sequence[str], c: str) -> Column:
    """The group is a family or one of its members ``family_*``; no family means any."""
    if not families:
        return F.lit(True)
    out = F.lit(False)
    for f in families:
        out = out | (F.col(c) == f) | F.col(c).startswith(f + "_")
    return F.coalesce(out, F.lit(False))


def autocomplete(aliases: DataFrame, query: str, n: int = 8) -> DataFrame:
    """Keys with an alias that holds the query: prefixes first, then shortest alias; each key once."""
    hits = aliases.filter(F.col("alias").contains(query)).withColumn("prefix", F.col("alias").startswith(query))
    order = [F.desc("prefix"), F.length("alias"), F.col("alias")]
    best = hits.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("__n = 1")
    return best.orderBy(*order, "key").limit(n).select("key", "alias", "prefix")


def shares(sums: DataFrame, key: str, by: str = "cents") -> DataFrame:
    """Positive sums with their share of the total in hundredths of a percent, rounded down."""
    rows = sums.filter(F.col(by) > 0)
    total = rows.agg(F.sum(by)).first()[0] or 1  # one number
    return rows.select(key, by, F.expr(f"({by} * 10000) div {total}").alias("share"))


def top_and_other(sums: DataFrame, key: str, n: int = 5, by: str = "cents") -> DataFrame:
    """The n largest sums and the rest as ``Other``."""
    top = sums.orderBy(F.desc(by), key).limit(n).select(key).withColumn("__top", F.lit(True))
    marked = sums.join(F.broadcast(top), key, "left")
    name = F.when(F.col("__top"), F.col(key)).otherwise("Other")
    return marked.groupBy(name.alias(key)).agg(F.sum(by).alias(by))


def year_month_pivot(lines: DataFrame, years: Sequence[int]) -> DataFrame:
    pivot = lines.withColumn("__year", F.year("day")).groupBy(F.month("day").alias("month_no")).pivot("__year", list(years))
    out = pivot.agg(F.sum("cents"))
    return out.select("month_no", *[F.col(str(y)).alias(f"y{y}") for y in years])
