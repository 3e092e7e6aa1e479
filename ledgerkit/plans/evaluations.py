"""Registered queries of the evaluation of cards as of each purchase's day, and of invariants."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerkit.operators import evaluation, insights, invariants, profiles, spending
from ledgerkit.plans.adapters import BANK_SQL, ITEM_SQL, TXN_SQL, bank, item, table, txn
from ledgerkit.plans.adapters import SERIES_SQL
from ledgerkit.plans.adapters import monthly_series as _series
from ledgerkit.plans.registration import registrar

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)
D = datetime.date

_CARD = "card string, place int, network string, worth int, fee int"
CARDS = [("blue", 1, "one", 100, 0), ("green", 2, "two", 150, 300), ("red", 3, "one", 80, 250)]
_RULE = (
    "card string, rule int, since date, until date, is_base boolean, categories array<string>, merchants array<string>, excluded array<string>, channel string, geography string, "
    "prepaid boolean, valid_from date, valid_to date, needs array<string>, rate int, after int, cap string, cap_cents long, period string"
)
_OLD, _NEW = D(1990, 1, 1), D(1998, 3, 1)
RULES = [
    ("blue", 1, _OLD, None, True, [], [], [], None, "any", False, None, None, [], 100, None, None, None, None),
    ("blue", 2, _OLD, None, False, ["promo_brushed_steel", "small_plated_tin"], [], [], None, "any", False, None, None, ["activation"], 500, 100, "q", 30_000_000, "quarter"),
    ("blue", 3, _OLD, None, False, ["standard_burnished_brass", "economy_anodized_steel"], [], ["economy_anodized_steel.brand21"], "in_store", "any", False, None, None, [], 450, 100, "q", 30_000_000, "quarter"),
    ("green", 1, _OLD, _NEW, True, [], [], ["medium_polished_copper"], None, "any", False, None, None, [], 200, None, None, None, None),
    ("green", 1, _NEW, None, True, [], [], [], None, "any", False, None, None, [], 150, None, None, None, None),
    ("green", 2, _OLD, None, False, [], ["shop7_gas", "shop9"], [], "online", "any", False, None, None, [], 400, 0, "m", 5_000_000, "month"),
    ("green", 3, _NEW, None, False, ["other", "small_plated_tin", "large_burnished_nickel"], ["shop3"], [], None, "outside_us", False, None, None, [], 600, None, None, None, None),
    ("red", 1, _OLD, None, True, [], [], [], None, "any", False, None, None, [], 50, None, None, None, None),
    ("red", 2, _OLD, None, False, ["large_burnished_nickel", "medium_polished_copper"], [], [], None, "us", True, D(1996, 1, 1), D(1999, 12, 31), ["membership"], 300, 50, "y", 80_000_000, "year"),
    ("red", 3, _OLD, None, False, ["promo_brushed_steel", "economy_anodized_steel"], [], [], "issuer_portal", "any", False, None, None, [], 1000, None, None, None, None),
    ("red", 4, _OLD, None, False, ["small_plated_tin"], [], [], None, "any", False, None, None, ["closed"], 900, None, "l", 900_000, "once"),
    ("red", 5, _OLD, None, False, ["standard_burnished_brass"], [], [], None, "any", False, None, None, [], 700, 20, "l", 60_000_000, "once"),
]
ANSWERS = [("blue", "activation", True), ("red", "closed", False)]
_CREDIT = "card string, credit string, place int, merchants array<string>, categories array<string>, cents long, spent long, enrolled boolean, valid_from date, valid_to date"
CREDITS = [
    ("blue", "gone", 1, [], ["promo_brushed_steel"], 100, 100, None, None, None),
    ("blue", "steel", 2, [], ["promo_brushed_steel"], 5_000, 2_000, True, None, None),
    ("blue", "shop", 3, ["shop5_web"], ["promo_brushed_steel"], 9_000, None, None, None, D(1999, 6, 30)),
    ("green", "unasked", 1, ["shop5_gas", "shop6_gas"], [], 700_000_000, 0, None, None, None),
    ("red", "never", 1, ["shop5_gas"], [], 900, 0, False, None, None),
]
_OFFER = "card string, offer string, merchant string, kind string, amount long, most long, least long, added boolean, channel string, expires date"
OFFERS = [
    ("blue", "cash", "shop2_web", "cash", 2_500, None, 10_000_000, True, None, None),
    ("blue", "share", "shop2_web", "percent", 1_000, 3_000, None, True, "online", None),
    ("green", "points", "shop2_gas", "points", 4_000, None, None, True, None, D(1997, 1, 1)),
    ("green", "more", "shop2_gas", "points_per_dollar", 300, 900, None, None, "in_store", None),
    ("red", "many", "shop8_gas", "points_per_dollar", 500, 100_000, None, True, None, None),
]
REFUSED = [("shop4_gas", "two"), ("shop1_web", "one")]


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, D):
        return f"DATE '{value}'"
    if isinstance(value, list):
        return f"CAST([{', '.join(map(_sql, value))}] AS VARCHAR[])"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _values(name: str, schema: str, rows: list) -> str:
    columns = ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)})"


_BUYS_SQL = f"""{TXN_SQL}, {ITEM_SQL},
buys AS (SELECT t.id, t.account, ['blue', 'green', 'red'][1 + t.id % 3] AS used, t.day, t.cents, 'shop' || t.account % 11 || CASE WHEN t.id % 2 = 0 THEN '_gas' ELSE '_web' END AS merchant,
  (SELECT min(category) FROM item WHERE order_id = t.id) AS category, CASE t.id % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'in_store' END AS channel, t.id % 5 = 0 AS abroad
  FROM txn t WHERE t.type = 'purchase' AND t.id IN (SELECT order_id FROM item))"""
_FITS_SQL = f"""{_BUYS_SQL}, {_values("r", _RULE, RULES)}, {_values("answers", "card, name, answer", ANSWERS)}, {_values("cards", _CARD, CARDS)},
met AS (SELECT b.*, r.card, r.rule, r.since, coalesce(r.channel = 'issuer_portal', false) AS portal, r.rate, coalesce(r.after, 0) AS after, r.cap, r.cap_cents,
  CASE r.period WHEN 'month' THEN date_trunc('month', b.day) WHEN 'quarter' THEN date_trunc('quarter', b.day) WHEN 'year' THEN date_trunc('year', b.day) ELSE DATE '1970-01-01' END AS start,
  (CASE WHEN r.channel IN ('in_store', 'online', 'in_app') AND b.channel IS NULL THEN 1 ELSE 0 END) + CAST(r.prepaid AS INTEGER) + (CASE WHEN r.valid_to - b.day <= 45 THEN 1 ELSE 0 END)
    + len(r.needs) - (SELECT count(*) FROM answers a WHERE a.card = r.card AND list_contains(r.needs, a.name)) AS caveats
  FROM buys b JOIN r ON b.day >= r.since AND (r.until IS NULL OR b.day < r.until)
  AND (r.is_base OR CASE WHEN len(r.merchants) > 0 AND r.channel IS DISTINCT FROM 'issuer_portal'
       THEN list_contains(list_transform(r.merchants, lambda m: split_part(m, '_', 1)), split_part(b.merchant, '_', 1))
            AND (len(list_filter(r.categories, lambda c: c <> 'other')) = 0 OR list_has_any(list_filter(r.categories, lambda c: c <> 'other'), [b.category, split_part(b.category, '.', 1)]))
       ELSE list_has_any(r.categories, [b.category, split_part(b.category, '.', 1)]) END)
  AND (r.is_base OR NOT list_contains(r.excluded, b.category)) AND NOT (coalesce(r.channel IN ('in_store', 'online', 'in_app') AND b.channel <> r.channel, false))
  AND NOT (r.geography = 'us' AND b.abroad) AND NOT (r.geography = 'outside_us' AND NOT b.abroad)
  AND (r.valid_from IS NULL OR b.day >= r.valid_from) AND (r.valid_to IS NULL OR b.day <= r.valid_to)
  AND NOT EXISTS (SELECT 1 FROM answers a WHERE a.card = r.card AND NOT a.answer AND list_contains(r.needs, a.name))),
spent AS (SELECT DISTINCT account, card, cap, start, day, id, CASE WHEN used = card THEN cents ELSE 0 END AS adds FROM met WHERE cap IS NOT NULL),
before AS (SELECT id, card, cap, coalesce(sum(adds) OVER (PARTITION BY account, card, cap, start ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM spent),
valued AS (SELECT met.*, CASE WHEN met.cap IS NULL THEN met.cents ELSE least(met.cents, greatest(cap_cents - gone, 0)) END AS inside, CASE WHEN met.cap IS NOT NULL THEN greatest(cap_cents - gone, 0) END AS room, worth
  FROM met JOIN cards USING (card) LEFT JOIN before ON before.id = met.id AND before.card = met.card AND before.cap = met.cap),
v AS (SELECT *, CAST(inside * rate + (cents - inside) * after AS BIGINT) AS units, CAST((inside * rate + (cents - inside) * after) * worth AS BIGINT) AS value FROM valued)"""
_EVAL_SQL = f"""{_FITS_SQL}, {_values("credits", _CREDIT, CREDITS)}, {_values("offers", _OFFER, OFFERS)}, {_values("refused", "merchant, network", REFUSED)},
best AS (SELECT id, card, rule, units, value, caveats FROM v WHERE NOT portal QUALIFY row_number() OVER (PARTITION BY id, card ORDER BY value DESC, rule) = 1),
gate AS (SELECT id, card, max(value) AS portal FROM v WHERE portal GROUP BY ALL),
cr AS (SELECT b.id, c.card, c.credit, CASE WHEN c.spent IS NULL THEN 0 ELSE least(c.cents - c.spent, b.cents) * 1000000 END AS value FROM buys b JOIN credits c
  ON coalesce(c.enrolled, true) AND c.cents > coalesce(c.spent, 0) AND (c.valid_to IS NULL OR b.day <= c.valid_to)
  AND CASE WHEN len(c.merchants) > 0 THEN list_contains(c.merchants, b.merchant) ELSE list_has_any(c.categories, [b.category, split_part(b.category, '.', 1)]) END
  QUALIFY row_number() OVER (PARTITION BY b.id, c.card ORDER BY c.place) = 1),
ov AS (SELECT b.id, o.card, o.offer, o.added, CAST(CASE WHEN b.cents < coalesce(o.least, 0) THEN 0 WHEN kind = 'cash' THEN CAST(amount AS BIGINT) * 1000000 WHEN kind = 'percent' THEN least(b.cents * amount * 100, coalesce(CAST(most AS BIGINT) * 1000000, 4611686018427387904))
    WHEN kind = 'points' THEN CAST(amount AS BIGINT) * worth * 10000 ELSE least(b.cents * amount, coalesce(CAST(most AS BIGINT) * 10000, 4611686018427387904)) * worth END AS BIGINT) AS value
  FROM buys b JOIN offers o ON o.merchant = b.merchant AND (o.expires IS NULL OR b.day <= o.expires) AND NOT coalesce(b.channel IN ('online', 'in_store') AND o.channel IN ('online', 'in_store') AND b.channel <> o.channel, false) JOIN cards USING (card)),
oc AS (SELECT *, coalesce(added, false) AND value > 0 AS counts FROM ov QUALIFY row_number() OVER (PARTITION BY id, card ORDER BY coalesce(added, false) AND value > 0 DESC, value DESC, offer DESC) = 1),
e AS (SELECT b.id, cards.card, best.rule, coalesce(best.units, 0) AS units, coalesce(best.value, 0) AS rule_value, CASE WHEN b.abroad THEN b.cents * cards.fee * 100 ELSE 0 END AS fee, cr.credit, coalesce(cr.value, 0) AS credit_value,
    oc.offer, CASE WHEN oc.counts THEN oc.value ELSE 0 END AS offer_value, best.caveats AS n_caveats, gate.portal, cards.place
  FROM buys b CROSS JOIN cards LEFT JOIN best ON best.id = b.id AND best.card = cards.card LEFT JOIN gate ON gate.id = b.id AND gate.card = cards.card LEFT JOIN cr ON cr.id = b.id AND cr.card = cards.card LEFT JOIN oc ON oc.id = b.id AND oc.card = cards.card
  WHERE (best.id IS NOT NULL OR gate.id IS NOT NULL OR cr.id IS NOT NULL OR oc.id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM refused f WHERE f.merchant = b.merchant AND f.network = cards.network)),
ev AS (SELECT *, rule_value + credit_value + offer_value - fee AS total, CASE WHEN portal > rule_value THEN portal - fee END AS portal_value FROM e),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY total DESC, fee > 0, place) AS rank FROM ev)"""


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _buys(spark, d):
    first = item(spark, d).groupBy(F.col("order_id").alias("id")).agg(F.min("category").alias("category"))
    used = F.element_at(F.array(F.lit("blue"), F.lit("green"), F.lit("red")), (F.col("id") % 3 + 1).cast("int"))
    merchant = F.concat(F.lit("shop"), F.col("account") % 11, F.when(F.col("id") % 2 == 0, "_gas").otherwise("_web"))
    channel = F.when(F.col("id") % 4 == 0, "online").when(F.col("id") % 4 == 1, "in_store")
    return txn(spark, d).filter("type = 'purchase'").join(first, "id").select("id", "account", used.alias("used"), "day", "cents", merchant.alias("merchant"), "category", channel.alias("channel"), (F.col("id") % 5 == 0).alias("abroad"))


def _tables(spark):
    return _frame(spark, RULES, _RULE), _frame(spark, ANSWERS, "card string, name string, answer boolean"), _frame(spark, CARDS, _CARD)


@query(f"WITH {_FITS_SQL} SELECT id, card, rule, portal, CAST(room AS BIGINT) AS room, units, value, CAST(caveats AS INTEGER) AS n_caveats FROM v")
def rule_values(spark, d):
    """Every rule version that applies to a purchase on its day, with the room that earlier purchases left under its cap."""
    rows = evaluation.rule_values(_buys(spark, d), *_tables(spark))
    return rows.select("id", "card", "rule", "portal", "room", "units", "value", F.size("caveats").alias("n_caveats"))


def _evaluated(spark, d):
    return evaluation.evaluate(_buys(spark, d), *_tables(spark), _frame(spark, CREDITS, _CREDIT), _frame(spark, OFFERS, _OFFER), _frame(spark, REFUSED, "merchant string, network string"))


@query(f"""WITH {_EVAL_SQL} SELECT id, card, rule, CAST(units AS BIGINT) AS units, CAST(rule_value AS BIGINT) AS rule_value, CAST(fee AS BIGINT) AS fee, credit, CAST(credit_value AS BIGINT) AS credit_value, offer, CAST(offer_value AS BIGINT) AS offer_value,
CAST(total AS BIGINT) AS total, CAST(portal_value AS BIGINT) AS portal_value, CAST(rank AS INTEGER) AS rank, CAST(n_caveats AS INTEGER) AS n_caveats FROM rk""")
def evaluated_cards(spark, d):
    """Rule, fee, credit and offer of every card on every purchase, ranked."""
    return _evaluated(spark, d).withColumn("n_caveats", F.when(F.col("caveats").isNotNull(), F.size("caveats"))).drop("caveats")


@query(f"""WITH {_EVAL_SQL}, net AS (SELECT *, rule_value - fee AS net FROM rk), top AS (SELECT id, card AS better, net AS possible FROM net QUALIFY row_number() OVER (PARTITION BY id ORDER BY net DESC, rank) = 1),
m AS (SELECT b.id, b.day, b.merchant, b.cents, b.used, coalesce(o.net, 0) AS earned, CASE WHEN possible > coalesce(o.net, 0) THEN better ELSE b.used END AS better, greatest(possible, coalesce(o.net, 0)) AS possible FROM buys b JOIN top USING (id) LEFT JOIN net o ON o.id = b.id AND o.card = b.used),
u AS (SELECT merchant, used FROM m GROUP BY merchant, used QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY count(*) DESC, min((day, id))) = 1), w AS (SELECT merchant, better FROM m GROUP BY merchant, better QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY count(*) DESC, min((day, id))) = 1)
SELECT merchant, used, better, count(*) AS purchases, CAST(sum(cents) AS BIGINT) AS spent, CAST(sum(earned) AS BIGINT) AS earned, CAST(sum(possible) AS BIGINT) AS possible, array_to_string((list(id ORDER BY day, id))[1:5], ',') AS first FROM (SELECT m.* EXCLUDE (used, better), u.used, w.better FROM m JOIN u USING (merchant) JOIN w USING (merchant)) GROUP BY ALL""")
def missed_by_merchant(spark, d):
    """What each merchant's purchases earned and could have earned, with the card most often used and most often better."""
    rows = evaluation.missed_by_merchant(_buys(spark, d), _evaluated(spark, d))
    return rows.withColumn("first", F.array_join(F.transform("first", lambda i: i.cast("string")), ","))


# Invariants.


@query(f"""WITH {TXN_SQL}, m AS (SELECT *, strftime(day, '%Y-%m') AS month, CASE WHEN id % 500 = 0 THEN cents + 1 ELSE cents END AS now FROM txn WHERE type = 'purchase' OR id % 2 = 0),
k AS (SELECT 'month' AS kind, month AS key, cents, now FROM m WHERE type <> 'payment' UNION ALL SELECT 'grp', grp, cents, now FROM m WHERE type <> 'payment' UNION ALL SELECT 'month|type', month || '|' || type, cents, now FROM m)
SELECT kind, key, count(*) AS n_then, CAST(sum(cents) AS BIGINT) AS cents_then, count(*) AS n_now, CAST(sum(now) AS BIGINT) AS cents_now FROM k GROUP BY kind, key HAVING sum(cents) <> sum(now)""")
def changed_figures(spark, d):
    """Figures of a snapshot that a few changed cents move."""
    t = txn(spark, d).filter("type = 'purchase' or id % 2 = 0")
    later = t.withColumn("cents", F.when(F.col("id") % 500 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return invariants.changed_figures(invariants.figures(t, ["grp"]), invariants.figures(later, ["grp"]))


@query(f"""WITH {BANK_SQL}, b AS (SELECT id, day, cents, CASE WHEN id % 10 = 0 THEN 'credit' WHEN cents > 0 THEN 'purchase' ELSE 'transfer' END AS type, id % 6 = 0 AS settled FROM bank),
p AS (SELECT id + 1000000 AS id, day + CAST(id % 12 AS INTEGER) AS day, -cents AS cents FROM bank WHERE cents > 0 AND id % 3 = 0), l AS (SELECT id, id + 1000000 - id % 2 * 3 AS card_id FROM bank WHERE id % 9 < 2 AND id % 3 = 0 OR id % 27 = 3)
SELECT 1 AS rule, id FROM b WHERE type IN ('purchase', 'refund', 'fee', 'interest', 'adjustment') AND id IN (SELECT id FROM l)
UNION ALL SELECT 2, card_id FROM l GROUP BY card_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 3, b.id FROM b JOIN p ON p.cents = -b.cents AND b.day - p.day BETWEEN -2 AND 6 WHERE b.type = 'purchase' AND NOT settled AND p.id NOT IN (SELECT card_id FROM l)
UNION ALL SELECT 4, id FROM b WHERE type IN ('payment', 'credit', 'reward', 'interest', 'adjustment')""")
def transfer_breaches(spark, d):
    """Breaches of the four rules of transfers."""
    b = bank(spark, d)
    kind = F.when(F.col("id") % 10 == 0, "credit").when(F.col("cents") > 0, "purchase").otherwise("transfer")
    rows = b.select("id", "day", "cents", kind.alias("type"), (F.col("id") % 6 == 0).alias("settled"))
    payments = b.filter("cents > 0 and id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.date_add("day", (F.col("id") % 12).cast("int")).alias("day"), (-F.col("cents")).alias("cents"))
    links = b.filter("id % 9 < 2 and id % 3 = 0 or id % 27 = 3").select("id", (F.col("id") + 1_000_000 - F.col("id") % 2 * 3).alias("card_id"))
    return invariants.transfer_breaches(rows, payments, links, -2, 6)


@query(f"""WITH {TXN_SQL}, x AS (SELECT id, ['one', 'two', 'three'][1 + account % 3] AS card, CASE id % 4 WHEN 0 THEN 'shop' WHEN 1 THEN 'shop_gas' WHEN 2 THEN 'shopper' END AS grp FROM txn WHERE type = 'purchase')
SELECT id, card FROM x WHERE card = 'one' AND (grp IS NULL OR grp = 'shopper') OR card = 'two' AND (grp IS NULL OR grp <> 'shop_gas')""")
def unexpected_purchases(spark, d):
    """Purchases of groups that their cards aren't kept for."""
    card = F.element_at(F.array(F.lit("one"), F.lit("two"), F.lit("three")), (F.col("account") % 3 + 1).cast("int"))
    group = F.when(F.col("id") % 4 == 0, "shop").when(F.col("id") % 4 == 1, "shop_gas").when(F.col("id") % 4 == 2, "shopper")
    t = txn(spark, d).select("id", card.alias("card"), "type", group.alias("group"))
    return invariants.unexpected_purchases(t, spark.createDataFrame([("one", ["shop"]), ("two", ["shop_gas"]), ("three", [])], "card string, groups array<string>"))


# Insights.

_REF = "DATE '1999-06-01'"


@query(f"""WITH {SERIES_SQL}, b AS (SELECT account, min(first) AS begins FROM ser GROUP BY account),
x AS (SELECT b.account, coalesce(c.cents, 0) AS cents, p.cents AS before FROM b JOIN ser p ON p.account = b.account AND p.first = {_REF} - INTERVAL 12 MONTH LEFT JOIN ser c ON c.account = b.account AND c.first = {_REF} WHERE begins <= {_REF} - INTERVAL 12 MONTH)
SELECT account, CAST(cents AS BIGINT) AS cents, CAST(before AS BIGINT) AS before, CASE WHEN cents > before THEN 'notice' ELSE 'info' END AS level FROM x WHERE before > 0 AND abs(cents - before) * 10 >= before AND abs(cents - before) >= 500""")
def against_last_year(spark, d):
    """Accounts whose June of 1999 differs enough from that of 1998."""
    return insights.against_last_year(_series(spark, d), F.lit("1999-06-01").cast("date"))


_PAID_SQL = f"""{SERIES_SQL}, pay AS (SELECT account, id, day, cents, date_trunc('month', day) AS first, CAST(1 + id % 3 AS INTEGER) AS months, account % 4 = 0 AS seasonal, row_number() OVER (PARTITION BY account ORDER BY day, id) = 1 AND account % 5 = 0 AS starts FROM txn WHERE cents > 0)"""


@query(f"""WITH {_PAID_SQL}, own AS (SELECT *, CAST(round_even(cents / months, 0) AS BIGINT) AS per FROM pay WHERE NOT starts),
fl AS (SELECT id, cents, seasonal, CASE WHEN count(*) OVER w >= 2 THEN CAST(round_even(median(per) OVER w, 0) AS BIGINT) * months END AS usual FROM own WINDOW w AS (PARTITION BY account ORDER BY day, id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
se AS (SELECT o.id, o.cents, (SELECT coalesce(sum(s.cents), 0) FROM ser s WHERE s.account = o.account AND s.first >= o.first - INTERVAL 12 MONTH AND s.first < o.first - INTERVAL 12 MONTH + to_months(o.months)) AS usual
  FROM own o WHERE seasonal AND o.first - INTERVAL 12 MONTH >= (SELECT min(first) FROM ser s WHERE s.account = o.account)),
u AS (SELECT id, cents, usual FROM fl WHERE NOT seasonal UNION ALL SELECT id, cents, usual FROM se)
SELECT id, CAST(usual AS BIGINT) AS usual, CASE WHEN cents >= 2 * usual THEN 'warning' ELSE 'notice' END AS level FROM u WHERE usual > 0 AND cents * 10 >= usual * 13""")
def payments_above_usual(spark, d):
    """Payments over one to three months, against earlier ones or, in seasonal accounts, against last year's months."""
    w = Window.partitionBy("account").orderBy("day", "id")
    starts = (F.row_number().over(w) == 1) & (F.col("account") % 5 == 0)
    pay = txn(spark, d).filter("cents > 0").select("account", "id", "day", "cents", F.trunc("day", "MM").alias("first"), (F.col("id") % 3 + 1).cast("int").alias("months"), (F.col("account") % 4 == 0).alias("seasonal"), starts.alias("starts"))
    return insights.unusual(pay, _series(spark, d))


@query(f"""WITH {SERIES_SQL}, l AS (SELECT *, 12 - row_number() OVER (PARTITION BY account ORDER BY first DESC) AS i FROM ser QUALIFY i >= 0), f AS (SELECT account, sum(cents) AS total FROM l GROUP BY account HAVING count(*) = 12),
s AS (SELECT a.account, a.month, a.i, sum(b.cents) AS cents FROM l a JOIN l b ON a.account = b.account AND (b.i - a.i + 12) % 12 < 5 GROUP BY ALL),
k AS (SELECT s.account, month AS start_month, cents, total FROM s JOIN f USING (account) QUALIFY row_number() OVER (PARTITION BY s.account ORDER BY cents DESC, i) = 1)
SELECT account, start_month, CAST(round_even(CAST(cents AS BIGINT) * 10000 / CAST(total AS BIGINT), 0) AS BIGINT) AS share FROM k WHERE total > 0 AND cents * 2 >= total""")
def season_insights(spark, d):
    """Accounts of which five months in a row hold half of a year's cost."""
    return insights.seasons(_series(spark, d))


# Listings.


@query(f"""WITH {TXN_SQL}, t AS (SELECT *, day + CAST(id % 5 AS INTEGER) AS post_day, CASE id % 3 WHEN 0 THEN 'fee' WHEN 1 THEN 'p2p' END AS flow_kind, CASE id % 2 WHEN 0 THEN 'one' ELSE 'two' END AS person,
  CASE id % 7 WHEN 0 THEN 'food.fish' WHEN 1 THEN 'uncategorized' WHEN 2 THEN 'foods' END AS own, CASE WHEN id % 11 = 0 THEN 'food' WHEN id % 11 = 1 THEN 'home' END AS part FROM txn)
SELECT id FROM t WHERE (post_day BETWEEN DATE '1996-11-01' AND DATE '1997-02-28' OR post_day BETWEEN DATE '1998-05-01' AND DATE '1998-05-31') AND (flow_kind = 'p2p' OR flow_kind IS NULL AND type IN ('p2p', 'purchase')) AND person = 'two'
AND (own = 'food' OR own LIKE 'food.%' OR part = 'food' OR type IN ('purchase', 'refund', 'fee', 'interest') AND coalesce(own, 'uncategorized') = 'uncategorized') AND id % 4 <> 1 ORDER BY day DESC, id DESC LIMIT 2000""")
def filtered_search(spark, d):
    """Transactions by posted month, flow, person, categories (split charges too) and open reviews together."""
    pick = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names], *[F.lit(None).cast("string")] * (n - len(names))), (F.col("id") % n + 1).cast("int"))
    t = txn(spark, d).withColumns({"post_day": F.date_add("day", (F.col("id") % 5).cast("int")), "flow_kind": pick(3, "fee", "p2p"), "person": pick(2, "one", "two"), "own_category": pick(7, "food.fish", "uncategorized", "foods")})
    parts = t.select("id", pick(11, "food", "home").alias("category")).filter("category is not null")
    parts = parts.unionByName(parts)  # a charge may have several parts of a category
    reviews = t.select(F.col("id").cast("string").alias("ref_id"), F.lit("transactions").alias("ref_table"), F.when(F.col("id") % 4 == 1, "closed").otherwise("open").alias("status"))
    months = ["1997-02", "1996-11", "1996-12", "1997-01", "1998-05"]
    return spending.search(t, months=months, posted=True, flows=["p2p", "purchase"], person="two", categories=["food", " uncategorized"], allocations=parts, reviews=reviews).select("id")


# Profiles: suppliers as cards, their lines as statements of documents.


@query("""WITH l AS (SELECT l_suppkey AS card, l_linenumber = 1 AND l_orderkey % 150 = 0 AS base, l_returnflag <> 'R' AS verified, CAST(l_quantity AS INTEGER) AS rate, l_partkey % 5 AS a, l_partkey % 3 AS b FROM lineitem),
ru AS (SELECT DISTINCT card, CASE WHEN base THEN 'base:' ELSE 'rule:' END || 'categories=' || CASE WHEN a = b THEN 'c' || a ELSE 'c' || least(a, b) || ',c' || greatest(a, b) END || ';channel' || CASE WHEN a = 1 THEN '=online' ELSE '' END || ';merchants=;rate=' || rate AS t, NOT base AS later FROM l WHERE verified),
rs AS (SELECT card, list(t ORDER BY later, t) AS rules, count(*) FILTER (NOT later) AS bases FROM ru GROUP BY card), d AS (SELECT card, count(*) FILTER (NOT verified) AS dropped FROM l GROUP BY card),
f AS (SELECT s_suppkey AS card, CASE WHEN s_suppkey % 7 > 0 THEN 9500 END AS annual, CASE WHEN s_suppkey % 11 > 0 THEN 300 END AS abroad FROM supplier)
SELECT f.card, CASE WHEN annual IS NULL THEN 'annual fee' WHEN abroad IS NULL THEN 'foreign fee' WHEN coalesce(bases, 0) <> 1 THEN 'base rule' ELSE 'ok' END AS state, coalesce(len(rules), 0) AS n_rules, coalesce(dropped, 0) AS dropped,
CASE WHEN annual IS NOT NULL AND abroad IS NOT NULL AND bases = 1 THEN sha256(annual || chr(10) || abroad || chr(10) || array_to_string(rules, chr(10)) || chr(10) || 'cents=500;name=gift;period=year') END AS content_hash FROM f LEFT JOIN rs USING (card) LEFT JOIN d USING (card)""")
def card_profiles(spark, d):
    """Profiles with hashes of their canonical text; the rows come in any order."""
    li = table(spark, d, "lineitem")
    c = lambda n: F.concat(F.lit("c"), F.col("l_partkey") % n)
    rules = li.select(F.col("l_suppkey").alias("card"), F.expr("l_linenumber = 1 and l_orderkey % 150 = 0").alias("is_base"), F.col("l_quantity").cast("int").alias("rate"), F.array(c(5), c(3), c(5)).alias("categories"), F.array().cast("array<string>").alias("merchants"), F.when(F.col("l_partkey") % 5 == 1, "online").alias("channel"), (F.col("l_returnflag") != "R").alias("verified"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("card"))
    part = lambda name, value, n: F.struct(F.lit(name).alias("part"), F.lit(value).alias("value"), (F.col("card") % n > 0).alias("verified"))
    fees = s.select("card", F.explode(F.array(part("annual", 9500, 7), part("foreign", 300, 11))).alias("p")).select("card", "p.*")
    credits = s.select("card", F.lit("gift").alias("name"), F.lit(500).alias("cents"), F.lit("year").alias("period"), F.lit(True).alias("verified"))
    return profiles.compose(fees, rules.orderBy(F.rand(3)), credits).select("card", "state", F.size("rules").alias("n_rules"), "dropped", "content_hash")
