"""Evaluation of cards as of a day: single conditions by hand; the queries are compared with DuckDB beside all others."""

import datetime

import pytest

from ledgerkit.operators import evaluation

D = datetime.date
RULE = "card string, rule int, since date, until date, is_base boolean, categories array<string>, merchants array<string>, excluded array<string>, channel string, geography string, prepaid boolean, valid_from date, valid_to date, needs array<string>, rate int, after int, cap string, cap_cents long, period string"
BUY = "id long, account long, used string, day date, cents long, merchant string, category string, channel string, abroad boolean"


def rule(**x):
    base = dict(card="c", rule=1, since=D(2000, 1, 1), until=None, is_base=False, categories=[], merchants=[], excluded=[], channel=None, geography="any", prepaid=False, valid_from=None, valid_to=None, needs=[], rate=100, after=None, cap=None, cap_cents=None, period=None)
    return tuple((base | x).values())


def buy(id_, **x):
    base = dict(id=id_, account=1, used="c", day=D(2024, 5, 10), cents=1000, merchant="shop_web", category="food.fish", channel=None, abroad=False)
    return tuple((base | x).values())


@pytest.mark.parametrize(
    "terms, purchase, caveats",
    [
        (dict(is_base=True, excluded=["food.fish"]), {}, []),
        (dict(categories=["food"]), {}, []),
        (dict(categories=["food.fish"]), {}, []),
        (dict(categories=["food"], excluded=["food.fish"]), {}, None),
        (dict(categories=["fish"]), {}, None),
        (dict(merchants=["shop"]), {}, []),
        (dict(merchants=["shop_gas"], categories=["other"]), {}, []),
        (dict(merchants=["shop"], categories=["gas"]), {}, None),
        (dict(merchants=["store"], categories=["food"]), {}, None),
        (dict(categories=["food"], channel="online"), {}, ["online only"]),
        (dict(categories=["food"], channel="online"), dict(channel="in_store"), None),
        (dict(categories=["food"], geography="us"), dict(abroad=True), None),
        (dict(categories=["food"], geography="outside_us"), {}, None),
        (dict(categories=["food"], valid_to=D(2024, 5, 9)), {}, None),
        (dict(categories=["food"], valid_to=D(2024, 5, 10), prepaid=True), {}, ["prepaid bookings only", "ends 2024-05-10"]),
        (dict(categories=["food"], valid_from=D(2024, 5, 11)), {}, None),
        (dict(categories=["food"], since=D(2024, 5, 11)), {}, None),
        (dict(categories=["food"], until=D(2024, 5, 10)), {}, None),
        (dict(categories=["food"], needs=["yes", "open"]), {}, ["needs open"]),
        (dict(categories=["food"], needs=["no"]), {}, None),
        (dict(categories=["food"]), dict(category=None, merchant=None), None),
        (dict(is_base=True), dict(category=None, merchant=None, channel="online", abroad=None), []),
    ],
)
def test_a_rule_fits(spark, terms, purchase, caveats):
    answers = spark.createDataFrame([("c", "yes", True), ("c", "no", False), ("d", "open", True)], "card string, name string, answer boolean")
    rows = evaluation.fitting(spark.createDataFrame([buy(1, **purchase)], BUY), spark.createDataFrame([rule(**terms)], RULE), answers).collect()
    assert [r.caveats for r in rows] == ([] if caveats is None else [caveats])


def test_room_of_a_shared_cap(spark):
    """Two rules share a cap; purchases on another card or of another month or account take nothing from it."""
    rules = [rule(rule=i, categories=["food"], rate=r, after=50, cap="k", cap_cents=2500, period="month") for i, r in ((1, 300), (2, 200))]
    buys = [buy(1), buy(2, used="other"), buy(3, day=D(2024, 5, 9), cents=1200), buy(4), buy(5, day=D(2024, 6, 1)), buy(6, account=2), buy(7)]
    rows = evaluation.rule_values(spark.createDataFrame(buys, BUY), spark.createDataFrame(rules, RULE), spark.createDataFrame([], "card string, name string, answer boolean"), spark.createDataFrame([("c", 150)], "card string, worth int"))
    got = {(r.id, r.rule): (r.room, r.units, r.value) for r in rows.collect()}
    assert {i: got[i, 1][0] for i in range(1, 8)} == {1: 1300, 2: 300, 3: 2500, 4: 300, 5: 2500, 6: 2500, 7: 0}
    assert all(got[i, 1][0] == got[i, 2][0] for i in range(1, 8))
    assert got[4, 1][1:] == (300 * 300 + 700 * 50, (300 * 300 + 700 * 50) * 150) and got[7, 2][1] == 1000 * 50
