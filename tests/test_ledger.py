"""Ledger operators: every query against DuckDB, and the reference vectors of the scalar functions by hand."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerkit.functions import dates, money, text
from ledgerkit.operators import knowledge, matching, reconcile, series
from ledgerkit.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
D = datetime.date


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    return sorted((tuple(None if x != x else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(sql)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(1).collect() is not None


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, cents", [("(20.08)", -2008), ("-$ 3,120.45", -312045), ("2.345", None), ("0.73000", 73), ("", None), ("$4,000", 400000)])
def test_to_cents(spark, raw, cents):
    assert one(spark, money.to_cents(F.lit(raw))) == cents


@pytest.mark.parametrize("total, parts, want", [(20003, 3, [6668, 6668, 6667]), (7, 10, [1] * 7 + [0] * 3), (-500, 3, [-167, -167, -166])])
def test_even_spread(spark, total, parts, want):
    assert one(spark, money.even_spread(F.lit(total), F.lit(parts))) == want


@pytest.mark.parametrize("total, weights, want", [(200, (1, 1, 1), [67, 67, 66]), (9, (0, 0), [9, 0]), (-500, (2, 2, 2), [-167, -167, -166])])
def test_largest_remainder(spark, total, weights, want):
    rows = spark.createDataFrame([(1, total, w, i) for i, w in enumerate(weights)], "g int, total long, w long, i int")
    assert [r.part for r in money.largest_remainder(rows, ["g"], "total", "w", ["i"]).orderBy("i").collect()] == want


@pytest.mark.parametrize("kind, want", [("month", (D(2026, 2, 1), D(2026, 2, 28), "2026-02")), ("quarter", (D(2026, 1, 1), D(2026, 3, 31), "2026-Q1")), ("half_year", (D(2026, 1, 1), D(2026, 6, 30), "2026-H1")), ("calendar_year", (D(2026, 1, 1), D(2026, 12, 31), "2026")), ("cardmember_year", (D(2025, 5, 10), D(2026, 5, 9), "2025-05-10"))])
def test_period_windows(spark, kind, want):
    assert tuple(one(spark, dates.period_window(F.lit("2026-02-14").cast("date"), kind, F.lit("2020-05-10").cast("date")))) == want


@pytest.mark.parametrize("raw, want", [("SQ *CORNER BAKERY 123 SEATTLE WA", "CORNER BAKERY SEATTLE"), ("big  store #0042", "BIG STORE"), ("12345", "12345"), ("SHOP SHOP 206-555-0100 OR", "SHOP")])
def test_clean_description(spark, raw, want):
    assert one(spark, text.clean_description(F.lit(raw))) == want


def test_text_functions(spark):
    assert one(spark, text.luhn_ok(F.lit("4539578763621486"))) is True and one(spark, text.luhn_ok(F.lit("4539578763621487"))) is False
    assert one(spark, text.normalize_alias(F.lit("Ben & Jerry’s™ Shop"))) == "ben and jerrys shop"
    assert one(spark, text.document_text(F.lit("“A” well-\nknown"))) == '"a" wellknown'
    assert one(spark, text.numbers_in(F.lit("1,200 and 3.5 and 1200"))) == [1200.0, 3.5]
    assert one(spark, text.host_allowed(F.lit("a.b.org"), ["b.org"])) and not one(spark, text.host_allowed(F.lit("ab.org"), ["b.org"]))


def test_descriptions_alike(spark):
    alike = lambda a, b: one(spark, matching.similar_descriptions(F.lit(a), F.lit(b)))
    assert alike("CORNER BAKERY SEATTLE", "CORNER BAKERY") and alike("THE CORNER BAKERY", "CORNER BAKERY") and not alike("MY SHOP", "SHOP") and not alike("ABC", "ABD")


def test_greedy_takes_nearest_and_cuts_chains(spark):
    left = spark.createDataFrame([(1, 5, D(2026, 1, 3)), (2, 5, D(2026, 1, 4)), (3, 5, D(2026, 6, 1)), (4, 7, D(2026, 1, 1))], "id long, cents long, day date")
    right = spark.createDataFrame([(11, 5, D(2026, 1, 3)), (12, 5, D(2026, 1, 1)), (13, 5, D(2026, 6, 2))], "id long, cents long, day date")
    got = matching.greedy(matching.candidates(left, right, ["cents"], -2, 6), ["l_cents"]).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == [(1, 11), (2, 12), (3, 13)]


def test_transfers_in_three_tiers(spark):
    day = D(2026, 3, 5)
    bank = spark.createDataFrame([(1, "a", day, 100), (2, "a", day, 50), (3, None, day, 70)], "id long, issuer string, day date, cents long")
    cards = spark.createDataFrame([(11, "a", day, -100), (12, "a", day, -20), (13, "a", day, -30), (14, "b", day, -70)], "id long, issuer string, day date, cents long")
    got = sorted((r.id, r.card_id, r.method) for r in matching.transfers(bank, cards).collect())
    assert got == [(1, 11, "named"), (2, 12, "group"), (2, 13, "group"), (3, 14, "amount")]


def test_balance_walk(spark):
    rows = [(1, i, D(2026, 1, i), 10, 100 - 10 * i) for i in range(1, 8)]
    frame = lambda r: spark.createDataFrame(r, "account long, id long, day date, cents long, balance long")
    assert reconcile.balance_walk(frame(rows)).count() == 0
    missing = [r for r in rows if r[1] != 4]
    assert [r.day for r in reconcile.balance_walk(frame(missing)).collect()] == [D(2026, 1, 5)]


def test_drift_and_steps(spark):
    rows = [(1, i, D(2026, m, 1), D(2026, m, d), 500) for i, (m, d) in enumerate([(1, 5), (3, 1), (3, 30), (4, 29)])]
    got = series.fix_drift(spark.createDataFrame(rows, "account long, id long, first date, day date, cents long")).orderBy("id").collect()
    assert [r.month for r in got] == ["2026-01", "2026-02", "2026-03", "2026-04"]
    flat = [(1, i, D(2026, 1 + i, 1), c) for i, c in enumerate([5000, 5000, 6000, 6000])]
    assert [tuple(r)[2:] for r in series.flat_steps(spark.createDataFrame(flat, "account long, id long, day date, cents long")).collect()] == [(5000, 6000)]


def test_quotes_are_found_on_other_pages(spark):
    pages = spark.createDataFrame([("d", 1, "First page"), ("d", 5, "The annual fee is $95.")], "doc string, page int, text string")
    quotes = spark.createDataFrame([(1, "d", 5, "annual fee"), (2, "d", 1, "annual fee"), (3, "d", 1, "no such")], "quote_id int, doc string, page int, quote string")
    assert {r.quote_id: (r.page, r.state) for r in knowledge.verify_quotes(quotes, pages).collect()} == {1: (5, "verified"), 2: (5, "moved"), 3: (None, "missing")}


def test_stream_drops_repeats_and_appends_once(spark, tmp_path):
    from ledgerkit.operators.ingest import occurrence_keys
    from ledgerkit.streaming.ingest import append_missing, deduplicated

    rows = occurrence_keys(spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts")), ["event_id"], ["ts"])
    for part in (rows, rows.filter("event_id % 2 = 0")):  # the second read overlaps the first
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_missing(deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == rows.count() == out.select("dedupe_key").distinct().count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
