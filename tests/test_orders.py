"""Orders and receipts on random ledgers: every reported decision is checked against all others."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerkit.operators import matching, orders

D0 = datetime.date(2024, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=n)


@pytest.mark.parametrize("walk", [200_000, 0])
def test_match_orders(spark, monkeypatch, walk):
    monkeypatch.setattr(matching, "WALK", walk)
    r = random.Random(11)
    amounts = [500, 900, 1500]
    book = [(i, f"o{i}", day(r.randrange(40)), r.choice(amounts), r.choice([None, "Visa", "visa gold", "Other"])) for i in range(90)]
    listed = [(i, f"o{r.randrange(110)}", day(r.randrange(40)), r.choice([*amounts, -500]), r.choice([None, "VISA"])) for i in range(25)]
    txns = []
    for i in range(130):
        d = r.randrange(45)
        refund = r.random() < 0.2
        txns.append((i, day(d), day(d + r.randrange(3)), r.choice([-500, -900]) if refund else r.choice(amounts), "refund" if refund else r.choice(["purchase", "purchase", "fee"]), f"o{r.randrange(120)}" if r.random() < 0.25 else None, r.choice(["Visa Gold Card", "Other Card"])))
    user = [(3, 5), (8, None), (9, 6)]
    frames = [
        spark.createDataFrame(txns, "id long, day date, post_day date, cents long, type string, order_ref string, product string"),
        spark.createDataFrame(book, "id long, ref string, day date, total long, payment string"),
        spark.createDataFrame(listed, "id long, ref string, day date, cents long, card string"),
        spark.createDataFrame(user, "id long, order_id long"),
    ]
    matches, reviews = orders.match_orders(*frames, -1, 4)
    got = {x.id: x for x in matches.collect()}
    told = {x.id: x for x in reviews.collect()}
    by_id, by_ref = {b[0]: b for b in book}, {b[1]: b for b in book}
    charge = {c[0]: c for c in listed}
    turn = {t[0]: (t[2], t[0]) for t in txns}
    used = {m.charge_id: turn[i] for i, m in got.items() if m.charge_id is not None}
    # A charge that gave no match of its own but was used shows as taken by a row that then fell between several orders.
    fits = lambda name, product: name is None or name.upper() in product.upper() or product.upper() in name.upper()
    cents = {t[0]: t[3] for t in txns}
    seen = set()
    for t in sorted(txns, key=lambda t: turn[t[0]]):
        i, when, _, amount, kind, ref, product = t
        if kind == "fee" or i in {u[0] for u in user}:
            assert i not in got and i not in told
            continue
        m = got.get(i)
        if ref in by_ref:
            assert (m.order_id, m.charge_id, m.method, m.confidence) == (by_ref[ref][0], None, "exact", 1.0)
            continue
        asked = sorted((abs((when - c[2]).days), c[0]) for c in listed if c[3] == amount and -1 <= (when - c[2]).days <= 4 and fits(c[4], product))
        taken = [c for _, c in asked if c not in seen][:1]  # what no earlier row has
        seen.update(taken)
        if taken and charge[taken[0]][1] in by_ref:
            assert (m.order_id, m.charge_id, m.method) == (by_ref[charge[taken[0]][1]][0], taken[0], "exact")
            continue
        near = []
        if kind == "purchase":
            for o in book:
                before = sum(cents[u] for u, x in user if x == o[0]) + sum(cents[j] for j, x in got.items() if x.order_id == o[0] and turn[j] < turn[i])
                if o[3] == amount and 0 <= (when - o[2]).days <= 10 and fits(o[4], product) and before + amount <= o[3]:
                    near.append(((when - o[2]).days, o[0]))
        best = [o for d, o in near if d == min(near)[0]]
        if len(best) == 1:
            assert (m.order_id, m.charge_id, m.method, m.confidence) == (best[0], taken[0] if taken else None, "window", 0.8)
        elif best:
            assert m is None and told[i].reason == "several" and told[i].candidates == sorted(by_id[o][1] for o in best)
        elif taken:
            assert (m.order_id, m.charge_id, m.method) == (None, taken[0], "charge_only") and told[i].reason == "no_invoice"
        else:
            assert m is None and told[i].reason == ("not_imported" if ref else "no_order")
    assert used and {m.method for m in got.values()} == {"exact", "window", "charge_only"} and {x.reason for x in told.values()} == {"several", "no_invoice", "not_imported", "no_order"}


@pytest.mark.parametrize("walk", [200_000, 0])
def test_match_receipts(spark, monkeypatch, walk):
    monkeypatch.setattr(matching, "WALK", walk)
    r = random.Random(2)
    receipts = [(i, day(r.randrange(40)), r.choice([10, 20, 30]), r.choice([None, "Visa", "Cash"])) for i in range(60)]
    txns = [(i, day(r.randrange(42)), r.choice([10, 20, 30]), r.choice(["purchase", "purchase", "refund"]), r.choice(["warehouse", "gas"])) for i in range(80)]
    frames = spark.createDataFrame(receipts, "id long, day date, total long, payment string"), spark.createDataFrame(txns, "id long, day date, cents long, type string, group string"), spark.createDataFrame([(4,), (5,)], "id long")
    matches, reviews, uncharged = orders.match_receipts(*frames, F.lit(day(45)), 14)
    got = {x.order_id: x.id for x in matches.collect()}
    turn = {x[0]: (x[1], x[0]) for x in receipts}
    owner = {t: turn[o] for o, t in got.items()}
    told, open_ = {("no_receipt", t[0]) for t in txns if t[3] == "purchase" and t[4] == "warehouse" and t[0] not in owner and t[0] not in (4, 5)}, set()
    for i, d, total, payment in receipts:
        free = [(abs((t[1] - d).days), t[0]) for t in txns if t[3] == "purchase" and t[0] not in (4, 5) and t[2] == total and 0 <= (t[1] - d).days <= 2 and not owner.get(t[0], (day(999),)) < turn[i]]
        best = [t for n, t in free if n == min(free)[0]]
        assert got.get(i) == (best[0] if len(best) == 1 else None)
        if len(best) > 1:
            told |= {("several", t) for t in best}
        if not best and (day(45) - d).days >= 14 and payment != "Cash":
            open_.add(i)
    assert {(x.reason, x.id) for x in reviews.collect()} == told and {x.id for x in uncharged.collect()} == open_ and open_ and len(got) > 10


def test_same_card(spark):
    rows = spark.createDataFrame([(None, "x"), ("", "x"), ("Visa", "My VISA Gold"), ("my visa gold plus", "Visa Gold"), ("Amex", "Visa"), ("Visa", None)], "a string, b string")
    assert [x.ok for x in rows.select(orders.same_card(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, True, True, True, False, False]


def test_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    matches, reviews = orders.match_orders(none("id long, day date, post_day date, cents long, type string, order_ref string, product string"), none("id long, ref string, day date, total long, payment string"), none("id long, ref string, day date, cents long, card string"), none("id long, order_id long"), -1, 4)
    assert matches.count() == reviews.count() == 0
