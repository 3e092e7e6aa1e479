"""Digests, snapshots and link rules by hand; their queries are compared with DuckDB beside all others."""

import datetime

from pyspark.sql import functions as F

from ledgerkit.operators import invariants

D = datetime.date
TXN = "id long, day date, cents long, type string, card string"


def rows(spark, *extra):
    return spark.createDataFrame([(1, D(2024, 1, 5), 100, "purchase", "a"), (2, D(2024, 1, 9), -40, "refund", None), (3, D(2024, 2, 1), 100, "purchase", "a"), (4, D(2024, 2, 2), -500, "payment", "a"), *extra], TXN)


def one(df):
    return tuple(df.first())


def test_digest_ignores_order_and_partitions(spark):
    t = rows(spark)
    a = one(invariants.digest(t))
    assert a == one(invariants.digest(t.orderBy(F.desc("id")).repartition(7))) == one(invariants.digest(t.select(*reversed(t.columns)))) and a[0] == 4
    assert invariants.same(t, t.orderBy(F.rand(1)))


def test_digest_finds_every_change(spark):
    t = rows(spark)
    a = one(invariants.digest(t))
    changed = [
        t.withColumn("cents", F.when(F.col("id") == 3, F.col("cents") + 1).otherwise(F.col("cents"))),
        t.withColumn("card", F.coalesce("card", F.lit(""))),
        t.withColumn("card", F.coalesce("card", F.lit("null"))),
        t.unionByName(t.filter("id = 1")),
        t.filter("id > 1"),
        t.select("id", "day", "cents", F.col("type").alias("card"), F.col("card").alias("type")),
        t.filter("false"),
    ]
    assert len({a, *[one(invariants.digest(c)) for c in changed]}) == len(changed) + 1
    assert one(invariants.digest(t.filter("false")))[0] == 0


def test_changed_figures(spark):
    t = rows(spark)
    then = invariants.figures(t, ["card"])
    assert invariants.changed_figures(then, invariants.figures(t, ["card"])).count() == 0
    later = rows(spark, (5, D(2024, 3, 1), 7, "purchase", None)).withColumn("cents", F.when(F.col("id") == 1, 101).otherwise(F.col("cents")))
    got = {tuple(r) for r in invariants.changed_figures(then, invariants.figures(later, ["card"])).collect()}
    assert got == {
        ("month", "2024-01", 2, 60, 2, 61), ("month", "2024-03", None, None, 1, 7), ("card", "a", 2, 200, 2, 201), ("card", "", 1, -40, 2, -33),
        ("month|type", "2024-01|purchase", 1, 100, 1, 101), ("month|type", "2024-03|purchase", None, None, 1, 7),
    }


def test_link_breaches(spark):
    txns = spark.createDataFrame([(1, 100, "purchase"), (2, -30, "refund"), (3, 50, "payment"), (4, 70, "purchase")], "id long, cents long, type string")
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (4, 13)], "id long, account long")
    series = spark.createDataFrame([(10, 50), (10, 20), (11, 49), (12, 70), (13, 70), (14, 1), (15, 0)], "account long, cents long")
    assert {tuple(r) for r in invariants.link_breaches(links, txns, series).collect()} == {(1, 4), (2, 3), (3, 11), (3, 14)}


def test_rules_hold_on_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    assert invariants.transfer_breaches(none("id long, day date, cents long, type string, settled boolean"), none("id long, day date, cents long"), none("id long, card_id long"), -2, 6).count() == 0
    assert invariants.unexpected_purchases(none("id long, card string, type string, group string"), none("card string, groups array<string>")).count() == 0
