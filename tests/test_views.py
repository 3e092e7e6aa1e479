"""Listings and statement lines by hand and by plain loops."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from ledgerkit.operators import statements, views

D = datetime.date


def test_at_least(spark):
    r = random.Random(2)
    ps = [round(r.random(), 2) for _ in range(7)]
    chance = lambda k: sum(__import__("math").prod(p if x else 1 - p for p, x in zip(ps, hit)) for hit in itertools.product((0, 1), repeat=len(ps)) if sum(hit) >= k)
    got = spark.range(1).select(*[views.at_least(k, F.array(*map(F.lit, ps))).alias(f"k{k}") for k in (0, 1, 3, 7, 9)]).first()
    assert all(abs(g - chance(k)) < 1e-9 for g, k in zip(got, (0, 1, 3, 7, 9)))


def test_months_before(spark):
    x = spark.range(1).select(views.months_before(F.lit("2025-07-31").cast("date"), 5).alias("x")).first().x
    assert x == D(2025, 2, 28)


def test_source_prefix_is_literal(spark):
    rows = spark.createDataFrame([("bank_a",), ("bankXa",), ("bank",), ("a_bank_b",)], "source string")
    assert [r.source for r in rows.filter(views.from_source("bank")).collect()] == ["bank_a"]


def test_other_side(spark):
    rows = spark.createDataFrame([(1, D(2025, 1, 1), 500), (11, D(2025, 1, 3), -200), (12, D(2025, 1, 4), -300)], "id long, day date, cents long")
    links = spark.createDataFrame([(1, 11, "group", -2), (1, 12, "group", -3)], "id long, card_id long, method string, days int")
    got = {(r.id, r.other_id, r.cents) for r in views.other_side(links, rows).collect()}
    assert got == {(1, 11, -200), (1, 12, -300), (11, 1, 500), (12, 1, 500)}


def test_renamed(spark):
    diff = spark.createDataFrame([("a", "removed", "t1"), ("b", "added", "t1"), ("c", "added", "t1"), ("d", "removed", "t2"), ("e", "same", "t1"), ("f", "removed", None), ("g", "added", None)], "item string, state string, terms string")
    got = {(r.item, r.state) for r in views.renamed(diff, "terms").collect()}
    assert got == {("a -> b", "reworded"), ("c", "added"), ("d", "removed"), ("e", "same"), ("f", "removed"), ("g", "added")}


def test_rewardable(spark):
    rows = spark.createDataFrame([(1, "c", "purchase", None), (2, "k", "purchase", None), (3, "k", "purchase", "p2p"), (4, "c", "fee", None)], "id long, account string, type string, flow_kind string")
    accounts = spark.createDataFrame([("c", "credit"), ("k", "checking")], "account string, kind string")
    assert {r.id for r in views.rewardable(rows, accounts).collect()} == {1, 2}


def test_insights_rank(spark):
    rows = spark.createDataFrame([("x", "info", -900, 1, "2025-01"), ("x", "warning", 900, 2, "2025-01"), ("a", "info", 100, None, "2025-02"), ("a", "info", 100, 1, "2025-01")], "kind string, severity string, impact long, account long, period string")
    assert [(r.severity, r.account) for r in views.ranked_insights(rows).orderBy("rank").collect()] == [("warning", 2), ("info", 1), ("info", None), ("info", 1)]


def test_statement_lines(spark):
    rows = [(1, "c", D(2025, 1, 5), 700, "CORNER STORE 12"), (2, "c", D(2025, 1, 7), 700, "CORNER STORE 12"), (3, "c", D(2025, 1, 7), 700, "OTHER PLACE"), (4, "d", D(2025, 1, 7), 700, "CORNER STORE 12")]
    lines = [(21, "c", D(2025, 1, 31), 2, D(2025, 1, 6), 700, "CORNER STORE", "PURCHASES"), (22, "c", D(2025, 1, 31), 1, D(2025, 1, 7), 700, "CORNER STORE 12 SPRINGFIELD", "PURCHASES"), (23, "c", D(2025, 1, 31), 3, D(2025, 1, 9), 700, "CORNER STORE", "PURCHASES"), (24, "c", D(2025, 1, 31), 4, D(2025, 1, 9), -50, "a statement credit", "CREDITS"), (25, "c", D(2025, 1, 31), 5, D(2025, 1, 9), 50, "X", "INTEREST CHARGED")]
    lines = spark.createDataFrame(lines, "id long, card string, period_end date, line_no int, day date, cents long, text string, section string")
    links = statements.link_lines(lines, spark.createDataFrame(rows, "id long, card string, day date, cents long, text string"))
    assert {tuple(r) for r in links.collect()} == {(22, 2), (21, 1)}
    made = {(r.text, r.type) for r in statements.rows_of_lines(lines, links).collect()}
    assert made == {("CORNER STORE", "purchase"), ("a statement credit", "credit"), ("X", "interest")}
