"""Reward rules: fit, earn with caps, credits and offers, ranking, missed rewards. Rule tables are configuration and small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.bounds import config_table

#: Rates are in basis points, money in cents, so every product is exact in hundredths of a basis-point cent.
DEFAULT_AMOUNT = 10_000


def fits(rule: str = "r", at: str = "t") -> Column:
    """Category (own, parent or any), exclusions, channel, brand and dates. Missing rule fields don't limit."""
    r, t = (lambda c: F.col(f"{rule}.{c}")), (lambda c: F.col(f"{at}.{c}"))
    parent = F.split_part(t("category"), F.lit("."), F.lit(1))
    category = r("category").isNull() | (r("category") == t("category")) | (r("category") == parent)
    excluded = F.coalesce(r("excluded") == t("category"), F.lit(False)) | F.coalesce(r("excluded") == parent, F.lit(False))
    brand = r("brand").isNull() | (r("brand") == t("brand"))
    dates = (r("valid_from").isNull() | (t("day") >= r("valid_from"))) & (r("valid_to").isNull() | (t("day") <= r("valid_to")))
    return category & ~excluded & brand & dates


def blended(cents: Column, rate: Column, after: Column, room: Column) -> Column:
    """Earnings in 1/10000 cents: ``rate`` up to the room that a cap leaves, ``after`` beyond; a null room is no cap."""
    inside = F.when(room.isNull(), cents).otherwise(F.least(cents, F.greatest(room, F.lit(0))))
    return (inside * rate + (cents - inside) * after).cast("long")


def best_rules(purchases: DataFrame, rules: DataFrame) -> DataFrame:
    """For each purchase and card the rule that earns most (first of equal ones): id, card, rule, value.

    rules: card, rule, category, excluded, brand, valid_from, valid_to, rate, after, room. A configuration table, see ``config_table``.
    """
    met = purchases.alias("t").join(config_table(rules).alias("r"), fits())
    value = blended(F.col("t.cents"), F.col("r.rate"), F.col("r.after"), F.col("r.room"))
    rows = met.select(F.col("t.id").alias("id"), F.col("r.card").alias("card"), F.col("r.rule").alias("rule"), value.alias("value"))
    # One row per purchase and card: an aggregation combines map-side where a window would sort all.
    best = rows.groupBy("id", "card").agg(F.max_by("rule", F.struct("value", (-F.col("rule")).alias("first"))).alias("rule"), F.max("value").alias("value"))
    return best


def ranked(values: DataFrame) -> DataFrame:
    """Cards of each purchase by value, then by name."""
    w = Window.partitionBy("id").orderBy(F.desc("value"), "card")
    return values.withColumn("rank", F.row_number().over(w))


def missed(purchases: DataFrame, values: DataFrame) -> DataFrame:
    """Purchases (with the card ``used``) valued by the card used and by the best one: id, used, better, missed."""
    best = ranked(values).filter("rank = 1").select("id", F.col("card").alias("better"), F.col("value").alias("best"))
    own = values.select("id", F.col("card").alias("used"), F.col("value").alias("own"))
    rows = purchases.select("id", "used").join(best, "id").join(own, ["id", "used"], "left")
    return rows.select("id", "used", "better", (F.col("best") - F.coalesce("own", F.lit(0))).alias("missed")).filter("missed > 0")


def cheat_sheet(categories: DataFrame, rules: DataFrame, amount: int = DEFAULT_AMOUNT) -> DataFrame:
    """Best and second card of each category (category, brand, day)."""
    rows = categories.withColumn("id", F.xxhash64("category")).withColumn("cents", F.lit(amount).cast("long"))
    top = ranked(best_rules(rows, rules)).filter("rank <= 2").join(rows.select("id", "category"), "id")
    return top.groupBy("category").agg(F.max(F.when(F.col("rank") == 1, F.col("card"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("card"))).alias("second"))


def offer_value(kind: Column, amount: Column, cap: Column, minimum: Column, spend: Column) -> Column:
    """Cents of an offer: cash back, a percentage (basis points) up to a cap; nothing below the minimum."""
    value = F.when(kind == "cash", amount).when(kind == "percent", F.least((spend * amount / 10_000).cast("long"), F.coalesce(cap, F.lit(2**62))))
    return F.when(spend >= F.coalesce(minimum, F.lit(0)), value).otherwise(0)


def credit_value(left: Column, amount: Column, known: Column) -> Column:
    """A credit counts only when its use is known, up to what is left."""
    return F.when(F.coalesce(known, F.lit(False)), F.least(left, amount)).otherwise(0)


def cap_use(purchases: DataFrame, rules: DataFrame) -> DataFrame:
    """Spend per card and shared cap; a purchase counts once however many rules share the cap."""
    hit = purchases.alias("t").join(config_table(rules).alias("r"), fits()).select(F.col("r.card").alias("card"), F.col("r.cap").alias("cap"), F.col("t.id").alias("id"), F.col("t.cents").alias("cents"))
    return hit.filter("cap is not null").dropDuplicates(["card", "cap", "id"]).groupBy("card", "cap").agg(F.sum("cents").alias("spent"))


def break_even(values: DataFrame, cents: Column) -> DataFrame:
    """How much more (per mille of its value) the second card would have to be worth to tie with the first."""
    top = ranked(values).filter("rank <= 2").groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("b"))
    return top.filter("b > 0").select("id", F.expr("(a * 1000) div b").alias("permille"))


def rewards_check(stated: DataFrame, predicted: DataFrame, least: int = 200) -> DataFrame:
    """Statements whose stated units differ from the prediction by at least ``least`` and over a tenth."""
    both = stated.join(predicted, "statement", "left").withColumn("delta", F.col("stated") - F.coalesce("predicted", F.lit(0)))
    return both.withColumn("flagged", (F.abs("delta") >= least) & (F.abs("delta") * 10 > F.abs("stated")))
