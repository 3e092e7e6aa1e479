"""Profiles, sources of tasks and merges by source: by hand and on permuted inputs."""

import random

from pyspark.sql import functions as F

from ledgerkit.operators import profiles

RULE = "card int, is_base boolean, rate int, categories array<string>, merchants array<string>, channel string, verified boolean"


def composed(spark, fees, rules, credits):
    frames = [spark.createDataFrame(fees, "card int, part string, value int, verified boolean"), spark.createDataFrame(rules, RULE), spark.createDataFrame(credits, "card int, name string, cents int, period string, verified boolean")]
    return {r.card: r for r in profiles.compose(*frames).collect()}


def test_profiles(spark):
    both = lambda card: [(card, "annual", 9500, True), (card, "foreign", 0, True)]
    base = lambda card, rate=1: (card, True, rate, [], [], None, True)
    fees = [*both(1), *both(2), *both(3), (4, "annual", 0, True), (4, "foreign", 3, False), (5, "foreign", 3, True), *both(6)]
    rules = [base(1), (1, False, 4, ["food", "gas", "food"], [], "online", True), (1, False, 9, [], [], None, False), (1, False, 0, [], [], None, True), base(2), base(2, 2), (3, False, 3, [], [], None, True), base(4), base(5), base(6), base(6)]
    credits = [(1, "gift", 500, "year", True), (1, "no", 1, "year", None), (7, "alone", 1, "year", True)]
    got = composed(spark, fees, rules, credits)
    assert {k: (r.state, r.dropped) for k, r in got.items()} == {1: ("ok", 3), 2: ("base rule", 0), 3: ("base rule", 0), 4: ("foreign fee", 0), 5: ("annual fee", 0), 6: ("ok", 0), 7: ("annual fee", 0)}
    assert got[1].rules == ["base:categories=;channel;merchants=;rate=1", "rule:categories=food,gas;channel=online;merchants=;rate=4"] and got[1].credits == ["cents=500;name=gift;period=year"]
    assert [k for k, r in got.items() if r.content_hash] == [k for k, r in got.items() if r.state == "ok"]
    r = random.Random(1)
    for rows in (fees, rules, credits):
        r.shuffle(rows)
    again = composed(spark, fees, [(*x[:3], x[3][::-1], *x[4:]) for x in rules], credits)
    assert {k: r.content_hash for k, r in again.items()} == {k: r.content_hash for k, r in got.items()}
    other = composed(spark, fees, [(*x[:2], x[2] + (x[0] == 1), *x[3:]) for x in rules], credits)
    assert other[1].content_hash != got[1].content_hash and other[6].content_hash == got[6].content_hash


def test_task_sources(spark):
    docs = [(1, 1, "terms", "active"), (1, 2, "terms", "stale"), (1, 3, "guide", "stale"), (1, 4, "guide", "retired"), (1, 5, "other", "active"), (1, 6, "terms", "active"), (2, 7, "terms", "active"), (2, 8, "terms", "candidate")]
    versions = [(1, 1, True, "a"), (1, 2, True, "b"), (1, 3, False, "c"), (2, 1, True, "d"), (3, 1, True, "e"), (4, 1, True, "f"), (5, 1, True, "g"), (6, 1, True, "h"), (7, 1, False, "i"), (8, 4, True, "j")]
    d, v = spark.createDataFrame(docs, "card int, doc_id int, kind string, status string"), spark.createDataFrame(versions, "doc_id int, version int, ok boolean, text_hash string")
    rows = profiles.task_sources(d, v, ["guide", "terms"])
    assert {tuple(r) for r in rows.collect()} == {(1, 3, "guide", "D1", "e"), (1, 1, "terms", "D2", "b"), (1, 6, "terms", "D3", "h"), (2, 8, "terms", "D1", "j")}
    key = lambda df, *more: {r.card: r.input_key for r in profiles.input_keys(df, "extract", *more).collect()}
    a = key(rows, 1, "m", 100)
    assert a == key(rows.orderBy(F.desc("ref")).repartition(5), 1, "m", 100) and len(set(a.values())) == 2
    assert a[1] != key(rows, 2, "m", 100)[1] != key(rows.filter("ref <> 'D3'"), 2, "m", 100)[1]


def test_requirements(spark):
    rules = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, [])], "card int, needs array<string>")
    credits = spark.createDataFrame([(1, "gift", True), (2, "gift", False), (2, "b", None)], "card int, name string, enrollment boolean")
    assert {tuple(r) for r in profiles.requirements(rules, credits).collect()} == {(1, "a"), (1, "b"), (1, "gift")}


def test_merges(spark):
    schema = "key string, source string, changed int, value string"
    a = spark.createDataFrame([("k", "ai", 9, "ai"), ("k", "seed", 1, "old"), ("k", "seed", 2, "new"), ("u", "user", 0, "mine"), ("u", "seed", 5, "theirs"), ("x", "nobody", 1, "?")], schema)
    want = {("k", "seed", 2, "new"), ("u", "user", 0, "mine")}
    assert {tuple(r) for r in profiles.merged_by_source(a).collect()} == want == {tuple(r) for r in profiles.merged_by_source(a.filter("key = 'u'"), a.filter("key <> 'u'"), a).collect()}
    seed = spark.createDataFrame([("new", "1"), ("same", "2"), ("moved", "3"), ("mine", "4")], "key string, value string")
    stored = seed.select("key", F.sha2("value", 256).alias("seed_hash")).filter("key <> 'new'").withColumn("source", F.when(F.col("key") == "mine", "user").otherwise("seed"))
    stored = stored.withColumn("seed_hash", F.when(F.col("key") == "same", F.col("seed_hash")).otherwise("x")).select("key", "source", "seed_hash").unionByName(spark.createDataFrame([("gone", "seed", "x"), ("own", "user", None), ("ai", "ai", None)], "key string, source string, seed_hash string"))
    changes = {tuple(r) for r in profiles.seed_changes(stored, seed).collect()}
    assert changes == {("new", "insert"), ("moved", "update"), ("gone", "delete")}
    after = stored.filter("key not in ('gone', 'moved')").unionByName(seed.filter("key in ('new', 'moved')").select("key", F.lit("seed").alias("source"), F.sha2("value", 256).alias("seed_hash")))
    assert profiles.seed_changes(after, seed).count() == 0
