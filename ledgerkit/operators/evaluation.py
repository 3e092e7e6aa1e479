"""What every card would have earned on every purchase, as of the purchase's day: rule versions in force, room left under caps, fees, credits, offers.

Rules meet purchases by hashed keys (a brand, a category or its parent, or everything), not by comparing all with all, and the other conditions
are judged on the rules that meet. Rules, credits, offers and answers are configuration (``config_table``); purchases are data. The
room under a cap is what earlier purchases on the card left of it in the cap's period: one running sum by account, card, cap and period.

Amounts are exact: a rate has two decimals (300 is 3 units a dollar), a currency's worth too (150 is 1.5 cents a unit), and values are millionths of a cent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.bounds import config_table

MICRO = 1_000_000
#: Channels that a purchase may name; a rule for one of them asks when the purchase doesn't say (fixed values).
CHANNELS = ("in_store", "online", "in_app")
PORTAL = "issuer_portal"
#: A rule that ends within so many days says so.
ENDS_SOON = 45


def brand(key: Column) -> Column:
    """``store_gas`` belongs to the brand ``store``."""
    return F.substring_index(key, "_", 1)


def parent(category: Column) -> Column:
    return F.substring_index(category, ".", 1)


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind), value)


def _asked(purchases: DataFrame) -> DataFrame:
    """Purchases with each of the keys that rules may have."""
    keys = F.array_distinct(F.array_compact(F.array(F.lit("*"), _key("b:", brand(F.col("merchant"))), _key("c:", F.col("category")), _key("c:", parent(F.col("category"))))))
    return purchases.withColumn("key", F.explode(keys))


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules by key: of base rules everything, of rules that name merchants these merchants' brands, else their categories."""
    brands = F.transform("merchants", lambda m: _key("b:", brand(m)))
    categories = F.transform("categories", lambda c: _key("c:", c))
    keys = F.when(F.col("is_base"), F.array(F.lit("*"))).when((F.size("merchants") > 0) & (F.coalesce("channel", F.lit("")) != PORTAL), brands).otherwise(categories)
    return rules.withColumn("key", F.explode(F.array_distinct(keys)))


def fitting(purchases: DataFrame, rules: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each purchase and rule version that applies: id, card, rule, portal, caveats, and both sides' further columns.

    purchases: id, account, used, day, cents, merchant, category, channel, abroad. rules: card, rule (their order), since, until (of the version, until
    exclusive), is_base, categories, merchants, excluded, channel, geography (any, us, outside_us), prepaid, valid_from, valid_to, needs (names), rate, after,
    cap (name), cap_cents, period. answers: card, name, answer. A need that is answered no excludes, one that isn't answered is a caveat;
    so is a channel that the purchase doesn't say. Portal rules come back apart: they are only alternatives.
    """
    said = answers.groupBy("card").agg(F.map_from_entries(F.collect_list(F.struct("name", "answer"))).alias("said"))
    rules = rules.join(said, "card", "left").withColumn("replies", F.transform("needs", lambda n: F.struct(n.alias("name"), F.when(F.col("said").isNotNull(), F.try_element_at("said", n)).alias("answer")))).drop("said", "needs")
    met = _asked(purchases.withColumnRenamed("channel", "place")).join(config_table(_keyed(rules)), "key")
    met = met.dropDuplicates(["id", "card", "rule", "since"])
    real = F.array_remove("categories", "other")
    covered = lambda a: F.array_contains(a, F.col("category")) | F.array_contains(a, parent(F.col("category")))
    portal = F.coalesce(F.col("channel") == PORTAL, F.lit(False))
    limited = ~portal & ~F.col("is_base") & (F.size("merchants") > 0) & (F.size(real) > 0)  # named merchants, but only in these categories
    elsewhere = F.col("channel").isin(*CHANNELS) & (F.col("place") != F.col("channel"))
    abroad = F.coalesce("abroad", F.lit(False))
    ok = (F.col("day") >= F.col("since")) & F.coalesce(F.col("day") < F.col("until"), F.lit(True)) & (~limited | covered(real))
    ok &= F.col("is_base") | ~F.array_contains("excluded", F.col("category"))
    ok &= ~F.coalesce(elsewhere, F.lit(False)) & ~((F.col("geography") == "us") & abroad) & ~((F.col("geography") == "outside_us") & ~abroad)
    ok &= F.coalesce(F.col("day") >= F.col("valid_from"), F.lit(True)) & F.coalesce(F.col("day") <= F.col("valid_to"), F.lit(True))
    ok &= ~F.exists("replies", lambda r: F.coalesce(~r["answer"], F.lit(False)))
    open_ = F.transform(F.filter("replies", lambda r: r["answer"].isNull()), lambda r: F.concat(F.lit("needs "), r["name"]))
    ends = F.when(F.datediff("valid_to", "day") <= ENDS_SOON, F.concat(F.lit("ends "), F.col("valid_to").cast("string")))
    caveats = F.concat(F.array_compact(F.array(F.when(F.col("channel").isin(*CHANNELS) & F.col("place").isNull(), F.concat("channel", F.lit(" only"))), F.when(F.col("prepaid"), "prepaid bookings only"), ends)), open_)
    return met.filter(ok).withColumns({"portal": portal, "caveats": caveats}).drop("key", "replies")


def period_start(day: Column, period: Column) -> Column:
    """The first day of a cap's month, quarter or year; one fixed day for caps that never renew."""
    return F.when(period.isin("month", "quarter", "year"), F.when(period == "month", F.trunc(day, "month")).when(period == "quarter", F.trunc(day, "quarter")).otherwise(F.trunc(day, "year"))).otherwise(F.lit("1970-01-01").cast("date"))


def with_room(fits: DataFrame) -> DataFrame:
    """``fits`` with ``room``: what earlier purchases on the card, in order of (day, id), left under the rule's cap. Null where there is none.

    A purchase counts once however many rules share the cap, and only on the card it was made with.
    """
    capped = fits.filter("cap is not null").withColumn("start", period_start(F.col("day"), F.col("period")))
    whole = Window.partitionBy("account", "card", "cap", "start")
    counted = F.row_number().over(whole.partitionBy("account", "card", "cap", "start", "id").orderBy("rule", "since")) == 1
    own = F.when(F.col("used") == F.col("card"), F.col("cents")).otherwise(0)
    capped = capped.withColumn("adds", F.when(counted, own).otherwise(0))
    up_to = F.sum("adds").over(whole.orderBy("day", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    capped = capped.withColumn("room", F.greatest(F.col("cap_cents") - (up_to - own), F.lit(0)).cast("long")).drop("start", "adds")
    return capped.unionByName(fits.filter("cap is null").withColumn("room", F.lit(None).cast("long")))


def rule_values(purchases: DataFrame, rules: DataFrame, answers: DataFrame, cards: DataFrame) -> DataFrame:
    """``fitting`` rules with room, units (hundredths of a unit per cent of a dollar) and value, by the card's currency: cards has card, worth."""
    rows = with_room(fitting(purchases, rules, answers)).join(config_table(cards.select("card", "worth")), "card")
    inside = F.coalesce(F.least("cents", "room"), F.col("cents"))
    units = inside * F.col("rate") + (F.col("cents") - inside) * F.coalesce("after", F.lit(0))
    return rows.withColumn("units", units.cast("long")).withColumn("value", (units * F.col("worth")).cast("long"))


def evaluate(purchases: DataFrame, rules: DataFrame, answers: DataFrame, cards: DataFrame, credits: DataFrame, offers: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """One row per purchase and card that some rule, credit or offer serves: id, card, rule, units, rule_value, fee, credit, credit_value, offer, offer_value, total, caveats, portal_value, rank.

    cards: card, place (their order), network, worth, fee (hundredths of a per cent abroad). credits: card, credit, place, merchants, categories, cents, spent (null: not known),
    enrolled (null: not known, or not needed), valid_from, valid_to. offers: card, offer, merchant, kind (cash, percent, points, points_per_dollar), amount, most, least, added, channel, expires.
    refused: merchant, network pairs that don't work. The best rule is the first of the highest value; the first credit that fits counts if its use is known; the best
    offer counts if it was added. ``portal_value`` is that of the best portal rule where it beats the rule. Cards rank by total, then without a fee abroad, then by place.
    """
    cards = config_table(cards)
    valued = rule_values(purchases, rules, answers, cards)
    best = F.max_by(F.struct("rule", "units", "value", "caveats"), F.when(~F.col("portal"), F.struct("value", -F.col("rule"))))
    found = valued.groupBy("id", "card").agg(best.alias("best"), F.max(F.when(F.col("portal"), F.col("value"))).alias("portal_value"))
    keys = purchases.select("id", "day", "cents", "merchant", "category", "channel", "abroad")
    found = found.join(_best_credits(keys, credits), ["id", "card"], "full").join(_best_offers(keys, offers, cards), ["id", "card"], "full")
    rows = keys.join(found, "id").join(cards.select("card", "place", "network", "fee"), "card")
    if refused is not None:
        rows = rows.join(config_table(refused.select("merchant", "network")), ["merchant", "network"], "left_anti")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    fee = F.when(F.coalesce("abroad", F.lit(False)), F.col("cents") * F.col("fee") * (MICRO // 10_000)).otherwise(0).cast("long")
    rows = rows.select("id", "card", "place", F.col("best.rule").alias("rule"), zero(F.col("best.units")).alias("units"), zero(F.col("best.value")).alias("rule_value"), fee.alias("fee"), "credit", zero(F.col("credit_value")).alias("credit_value"), "offer", zero(F.col("offer_value")).alias("offer_value"), F.col("best.caveats").alias("caveats"), "portal_value")
    rows = rows.withColumn("total", F.expr("rule_value + credit_value + offer_value - fee")).withColumn("portal_value", F.when(F.col("portal_value") > F.col("rule_value"), F.col("portal_value") - F.col("fee")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("total"), F.col("fee") > 0, "place"))).drop("place")


def _in_force(day: Column, begins: str, ends: str) -> Column:
    return F.coalesce(day >= F.col(begins), F.lit(True)) & F.coalesce(day <= F.col(ends), F.lit(True))


def _best_credits(purchases: DataFrame, credits: DataFrame) -> DataFrame:
    """id, card, credit, credit_value: the first credit of the card that serves the purchase and has something left."""
    named = F.size("merchants") > 0
    keys = F.when(named, F.transform("merchants", lambda m: _key("m:", m))).otherwise(F.transform("categories", lambda c: _key("c:", c)))
    live = credits.filter("coalesce(enrolled, true) and cents > coalesce(spent, 0)").withColumn("key", F.explode(F.array_distinct(keys))).withColumnRenamed("cents", "most")
    asked = purchases.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(_key("m:", F.col("merchant")), _key("c:", F.col("category")), _key("c:", parent(F.col("category"))))))))
    met = asked.join(config_table(live), "key").filter(_in_force(F.col("day"), "valid_from", "valid_to"))
    left = F.least(F.col("most") - F.coalesce("spent", F.lit(0)), F.col("cents"))
    value = F.when(F.col("spent").isNotNull(), left * MICRO).otherwise(0)
    first = met.groupBy("id", "card").agg(F.min_by(F.struct("credit", value.alias("value")), "place").alias("c"))
    return first.select("id", "card", F.col("c.credit").alias("credit"), F.col("c.value").cast("long").alias("credit_value"))


def offer_value(kind: Column, amount: Column, most: Column, least: Column, cents: Column, worth: Column) -> Column:
    """Millionths of a cent of an offer: cash (cents), percent (hundredths), points, or points per dollar (hundredths), up to ``most`` (cents or points)."""
    percent = F.least(cents * amount * (MICRO // 10_000), F.coalesce(most * MICRO, F.lit(2**62)))
    points = F.least(cents * amount, F.coalesce(most * 10_000, F.lit(2**62))) * worth
    value = F.when(kind == "cash", amount * MICRO).when(kind == "percent", percent).when(kind == "points", amount * worth * 10_000).when(kind == "points_per_dollar", points)
    return F.when(cents >= F.coalesce(least, F.lit(0)), value).otherwise(0).cast("long")


def _best_offers(purchases: DataFrame, offers: DataFrame, cards: DataFrame) -> DataFrame:
    """id, card, offer, offer_value: of the offers at the merchant the best that counts, else the best that would."""
    known = offers.join(cards.select("card", "worth"), "card").withColumnRenamed("channel", "at")
    met = purchases.join(config_table(known), "merchant").filter(F.coalesce(F.col("day") <= F.col("expires"), F.lit(True)))
    met = met.filter(~F.coalesce(F.col("channel").isin("online", "in_store") & F.col("at").isin("online", "in_store") & (F.col("channel") != F.col("at")), F.lit(False)))
    value = offer_value(F.col("kind"), F.col("amount"), F.col("most"), F.col("least"), F.col("cents"), F.col("worth"))
    met = met.withColumn("value", value).withColumn("counts", F.coalesce("added", F.lit(False)) & (F.col("value") > 0))
    best = met.groupBy("id", "card").agg(F.max_by(F.struct("offer", "value", "counts"), F.struct("counts", "value", "offer")).alias("o"))
    return best.select("id", "card", F.col("o.offer").alias("offer"), F.when(F.col("o.counts"), F.col("o.value")).otherwise(0).cast("long").alias("offer_value"))


def missed_by_merchant(purchases: DataFrame, values: DataFrame, examples: int = 5) -> DataFrame:
    """merchant, purchases, spent, used, better, earned, possible, first: each merchant's purchases on the card used against the best one.

    values: ``evaluate``'s rows; earned and possible are rule values less fees. ``used`` and ``better`` are the cards most often used and best (of equally
    frequent ones the first met, by day and id); ``first`` has the ids of the first purchases.
    """
    net = F.col("rule_value") - F.col("fee")
    best = values.withColumn("net", net).groupBy("id").agg(F.max_by("card", F.struct("net", -F.col("rank"))).alias("better"), F.max("net").alias("possible"))
    own = values.select("id", F.col("card").alias("used"), net.alias("earned"))
    rows = purchases.join(best, "id").join(own, ["id", "used"], "left").withColumn("earned", F.coalesce("earned", F.lit(0)))
    rows = rows.select("id", "day", "merchant", "cents", "used", F.when(F.col("possible") > F.col("earned"), F.col("better")).otherwise(F.col("used")).alias("better"), "earned", F.greatest("possible", "earned").alias("possible"))

    def most(card: str) -> DataFrame:
        each = rows.groupBy("merchant", card).agg(F.count("*").alias("n"), F.min(F.struct("day", "id")).alias("at"))
        return each.groupBy("merchant").agg(F.min_by(card, F.struct(-F.col("n"), F.col("at"))).alias(card))

    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy("merchant").orderBy("day", "id"))).filter(F.col("nth") <= examples)
    first = nth.groupBy("merchant").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "id"))), lambda x: x.id).alias("first"))
    sums = rows.groupBy("merchant").agg(F.count("*").alias("purchases"), F.sum("cents").alias("spent"), F.sum("earned").alias("earned"), F.sum("possible").alias("possible"))
    return sums.join(most("used"), "merchant").join(most("better"), "merchant").join(first, "merchant")
