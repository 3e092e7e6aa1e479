"""Names of texts are ranks: equal under any partitioning, and right when all blocks share their hashes."""

from pyspark.sql import functions as F

from ledgerkit.llm import exact_dedup


def names(docs):
    return {r.k: (r.n_blocks, r.name) for r in exact_dedup.identities(docs.withColumn("k", F.col("doc_id")), "k", 64).collect()}


def test_names_dont_depend_on_partitions(docs, spark):
    some = docs.filter("length(text) < 3000").select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        want = names(some)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert names(some.repartition(3)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_that_share_their_hashes(docs, monkeypatch):
    some = docs.filter("length(text) < 400").select("doc_id", "text").limit(40)
    want = names(some)
    monkeypatch.setattr(exact_dedup, "_hashes", lambda block: (F.length(block).cast("long"), F.lit(0).cast("long")))
    assert names(some) == want
