"""Queries whose work once grew faster than their rows: results on larger or denser tables, within times that only growth in proportion meets."""

import datetime
import itertools
import json
import random
import time

import duckdb
from pyspark.sql import functions as F

from ledgerkit.functions import money
from ledgerkit.operators import matching, terms
from ledgerkit.plans.queries import ORACLE, QUERIES
from ledgerkit.sources import orders

SF = "/root/testdata/sf0.1"


def same_rows(spark, tmp_path, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / name))
    con.sql(f"CREATE TABLE want AS {ORACLE[name]}")
    columns = ", ".join(r[0] for r in con.sql("DESCRIBE want").fetchall())
    con.sql(f"CREATE TABLE got AS SELECT {columns} FROM '{tmp_path}/{name}/*.parquet'")
    assert con.sql("SELECT count(*) FROM want").fetchall()[0][0] > 0
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 5").fetchall() == []


def test_first_fit_grows_with_its_rows(spark):
    """A walk that looks through all right rows for each left one needs minutes here."""
    pairs = spark.range(40_000).selectExpr("id AS l_id", "id + 7 AS r_id", "cast(id % 5 AS int) AS days", "0L AS filled", "100L AS step", "id AS l_cents", "date'2024-01-01' AS l_day")
    began = time.perf_counter()
    got = matching.first_fit(pairs, ["l_day", "l_id"], ["l_cents"]).agg(F.count("*"), F.sum((F.col("r_id") - F.col("l_id") == 7).cast("int")), F.max("ties")).first()
    assert tuple(got) == (40_000, 40_000, 1) and time.perf_counter() - began < 30


def test_first_fit_of_one_value(spark):
    """One component whose rows come in several batches: each right row has room for one, left rows take them in turn."""
    day = datetime.date(2024, 1, 1)
    left = spark.range(200).select("id", F.lit(day).alias("day"), F.lit(5).alias("cents"))
    right = spark.range(150).select("id", F.date_sub(F.lit(day), F.col("id").cast("int")).alias("day"), F.lit(5).alias("cents"))
    pairs = matching.candidates(left, right, ["cents"], 0, 149).withColumns({"filled": F.lit(0).cast("long"), "step": F.lit(1).cast("long")})
    got = {(r.l_id, r.r_id, r.days, r.ties) for r in matching.first_fit(pairs, ["l_day", "l_id"], ["l_cents"]).collect()}
    assert got == {(i, i, i, 1) for i in range(150)}


def test_order_reviews(spark, tmp_path):
    began = time.perf_counter()
    same_rows(spark, tmp_path, "order_reviews", "orders")
    assert time.perf_counter() - began < 45


def test_uncharged_orders(spark, tmp_path):
    began = time.perf_counter()
    same_rows(spark, tmp_path, "uncharged_orders", "orders")
    assert time.perf_counter() - began < 45


def test_greedy_by_day_without_pairs(spark):
    """One value, thousands of rows a day: hundreds of millions of pairs, which are never made. On a fortieth of the rows the result is that of the walk over pairs."""
    side = lambda n, first: spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.date_add(F.lit(datetime.date(2024, 1, first)), (F.col("id") % 8).cast("int")).alias("day"), F.lit(5).alias("cents"))
    began = time.perf_counter()
    got = matching.greedy_by_day(side(32_000, 1), side(24_000, 2), ["cents"], -2, 6)
    assert tuple(got.agg(F.count("*"), F.count_distinct("l_id"), F.count_distinct("r_id")).first()) == (24_000,) * 3
    assert time.perf_counter() - began < 30
    few = side(800, 1).unionByName(spark.sql("SELECT 9000L AS id, cast(null AS date) AS day, 5 AS cents")), side(600, 2)
    want = matching.greedy(matching.candidates(*few, ["cents"], -2, 6), ["l_cents"]).select("l_id", "r_id", "days")
    assert sorted(matching.greedy_by_day(*few, ["cents"], -2, 6).collect()) == sorted(want.collect())


def test_first_sums_of_free_payments():
    """Rows in turn against a look at all twos and threes, for few values, many repeated ones, and values far apart; ids as texts too."""
    r = random.Random(8)
    for values in ([1, 2, 3, 5, 8], list(range(1, 40)), [r.randrange(1, 10**7) for _ in range(25)]):
        for case in range(60):
            make = str if case % 2 else int
            free = [(r.randrange(4), make(i), r.choice(values), i % 9) for i in range(r.randrange(0, 24))]
            payments = matching.free_payments()(free)
            payments.FEW = r.choice([0, 4, 2048])  # 0: no sums are listed
            for _ in range(12):
                cents = sum(r.choice(values) for _ in range(r.randrange(1, 4)))
                rows = sorted(free, key=lambda x: x[:2])
                want = next((g for n in (2, 3) for g in itertools.combinations(rows, n) if sum(x[2] for x in g) == cents), ())
                assert payments.take(cents) == [(x[1], x[3]) for x in want]
                free = [x for x in free if x not in want]


def test_transfers_of_a_dense_ledger(spark):
    """40 days of one issuer, 40 rows a side and day: millions of sums of three, which once were listed and settled in rounds."""
    r = random.Random(6)
    frame = lambda sign: spark.createDataFrame([(i, "a", datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 40), sign * r.randrange(1, 400)) for i in range(1600)], "id long, issuer string, day date, cents long")
    began = time.perf_counter()
    got = matching.transfers(frame(1), frame(-1)).collect()
    assert time.perf_counter() - began < 40
    assert len({x.card_id for x in got}) == len(got) and {x.method for x in got} >= {"named", "group"}


def _dense(spark, n, first):
    """n rows of two values within eight days; and rows without a day or cents."""
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.date_add(F.lit(datetime.date(2024, 1, first)), (F.col("id") % 8).cast("int")).alias("day"), F.floor(F.col("id") / 8 % 2).alias("cents"))
    return rows.unionByName(spark.sql(f"SELECT {n}L AS id, cast(null AS date) AS day, 1L AS cents UNION ALL SELECT {n + 1}L, date'2024-01-04', null"))


def test_nearest_both_without_pairs(spark):
    few = _dense(spark, 300, 1), _dense(spark, 200, 4)
    want = matching.mutual_nearest(matching.candidates(*few, ["cents"], -2, 6)).select("l_id", "r_id", "days")
    assert sorted(matching.nearest_both(*few, ["cents"], -2, 6).select("l_id", "r_id", "days").collect()) == sorted(want.collect())
    began = time.perf_counter()
    assert matching.nearest_both(_dense(spark, 60_000, 1), _dense(spark, 50_000, 4), ["cents"], -2, 6).count() >= 10  # of over a billion pairs
    assert time.perf_counter() - began < 30


def test_nearest_ties_without_other_pairs(spark):
    few = _dense(spark, 300, 1), _dense(spark, 200, 4)
    want = matching.unambiguous_nearest(matching.candidates(*few, ["cents"], -2, 6)).select("l_id", "r_id", "days", "ties")
    assert sorted(matching.nearest_ties(*few, ["cents"], -2, 6).collect()) == sorted(want.collect())
    # Of a billion pairs only those of the same or the nearest day are made, and no pair is shuffled.
    near = matching.nearest_ties(_dense(spark, 300, 1), _dense(spark, 200, 4), ["cents"], -2, 6)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan.split("\n")[1]


def test_with_candidates_without_pairs(spark):
    few = _dense(spark, 300, 1), _dense(spark, 200, 6)
    want = {r.l_id for r in matching.candidates(*few, ["cents"], -2, 6).select("l_id").collect()}
    got = [r.l_id for r in matching.with_candidates(*few, ["cents"], -2, 6).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got) < 300
    began = time.perf_counter()
    assert matching.with_candidates(_dense(spark, 60_000, 1), _dense(spark, 50_000, 1), ["cents"], -2, 6).count() == 60_000  # of over a billion pairs
    assert time.perf_counter() - began < 30


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_invoices_are_folded_once(spark):
    """A filter of empty arrays below explode once folded each invoice's lines three times."""
    plan = _optimized(QUERIES["invoice_items"](spark, "/root/testdata/sf0.001"))
    assert plan.count("aggregate(slice(") == 1 and plan.count("Generate explode") == 1


def test_item_lines_by_hand(spark):
    """Numbers below a price count once, right below it and only for a single article; a price without a title is a title; commas and signs."""
    head = "Order placed May 3, 2026 Order # 114-1234567-7654321\nGrand Total: $1.00\n"
    body = ["$1.00", "Pen", "Sold by:", "Sold by: A", "noise", "-$1,234.50", "2", "3", "Cup", "$,.50", "Delivered", "4", "0 of Box", "$2.00", "5", "QTY: 1 Mug", "$999,999,999,999,999.99", "2"]
    (r,) = orders.invoices(spark.createDataFrame([("f", head + "\n".join(body))], "file string, text string")).collect()
    assert [tuple(x)[1:6] for x in r["items"]] == [
        ("$1.00 Pen Sold by:", "A", 2, -246900, -123450),
        ("3 Cup", None, 1, 50, 50),
        ("4 0 of Box", None, 5, 1000, 200),
        ("Mug", None, 2, 199999999999999998, 99999999999999999),
    ]


def test_receipts_are_read_once(spark):
    """A filter of empty arrays below explode once read each receipt's JSON six times more."""
    plan = _optimized(QUERIES["receipt_items"](spark, "/root/testdata/sf0.001"))
    assert plan.count("from_json") == 1


def test_odd_amounts_of_receipts(spark):
    """The short way for plain amounts gives what the long one does, in items and totals."""
    amounts = ["1.00", "-0.05", "(2.50)", "$1,000.00", "3", "-4", "1.005", "x", None, " 7.00 ", "8.00\n", "99999999999999.99", "123456789012345.67", "1e2", ".50", "٣.00"]
    item = lambda a: {"item_number": "1", "description": "d", "amount": a, "taxable": True}
    docs = [(str(i), json.dumps({"date": "2026-05-01", "warehouse": "w", "items": [item(a)], "subtotal": a, "tax": "0", "total": a, "tender": {}})) for i, a in enumerate(amounts)]
    rows = orders.receipts(spark.createDataFrame(docs, "file string, text string")).select("file", "total", F.get("items", 0).cents.alias("cents")).collect()
    want = {str(i): r.c for i, r in enumerate(spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, a string").orderBy("i").select(money.to_cents(F.col("a")).alias("c")).collect())}
    assert {r.file: r.total for r in rows} == want
    assert {r.file: r.cents for r in rows} == {k: v if v is not None and v >= 0 else None for k, v in want.items()}


def test_scan_shuffles_what_it_finds(spark):
    """Every run of every document once went through the shuffle; few terms are looked for where they begin, in one pass over the words."""
    plan = _optimized(QUERIES["term_scan"](spark, "/root/testdata/sf0.001"))
    above, below = plan[: plan.index("Generate")], plan[plan.index("Generate") : plan.index("Relation [doc_id")]
    assert above.index("Aggregate") < above.index("Join") and below.count("regexp_extract_all(lower(text") == 1 and "Filter" not in below


def test_scan_of_few_and_many_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "The end, the END"), (3, ""), (4, None), (5, "b"), (6, "c a")], "doc_id int, text string")
    known = spark.createDataFrame([(t,) for t in ("a b", "a b c", "A-B", "the", "end the end", "b", "c d", "!", "a b", None)], "term string")
    want = [(1, "A-B", 2, 0), (1, "a b", 2, 0), (1, "a b c", 1, 2), (1, "b", 2, 1), (2, "end the end", 1, 1), (2, "the", 2, 0), (5, "b", 1, 0)]
    for most in (10_000, 5, 2, 0):  # as many words that begin terms as are looked for one by one, and terms that are broadcast
        monkeypatch.setattr(terms, "CONFIG_ROWS", most)
        assert sorted(map(tuple, terms.scan(docs, known).collect())) == want
    assert terms.scan(docs, known.limit(0)).count() == 0
