"""Scan of documents for many terms of one or more words.

Words are runs of letters and digits in lower case. Each document is read once. Where terms begin with at most ``CONFIG_ROWS`` different words, only
places of these words are looked at; of at most as many terms what is found is told by a broadcast table, and only found terms are shuffled.
Terms may be many more, and nothing that grows is broadcast: then runs are counted within their document before they are shuffled to the
terms, and adaptive execution splits a run that many documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.functions.bounds import CONFIG_ROWS

#: Words of the longest term; longer ones are refused.
MOST_WORDS = 12


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def scan(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, n, first): how often each term occurs in a document, and the place of its first word from 0. Terms without a word don't occur."""
    known = terms.select("term", words(F.col("term")).alias("words")).filter("size(words) > 0").dropDuplicates(["term"])
    sizes = [r[0] for r in known.select(F.size("words")).distinct().limit(MOST_WORDS + 2).collect()]
    if max(sizes, default=0) > MOST_WORDS:
        raise ValueError(f"a term has over {MOST_WORDS} words")
    begins = [r[0] for r in known.select(F.get("words", 0)).distinct().limit(CONFIG_ROWS + 1).collect()]
    few = known.limit(CONFIG_ROWS + 1).count() <= CONFIG_ROWS
    known = known.select("term", F.array_join("words", " ").alias("run"))
    texts = docs.select(key, words(F.col("text")).alias("w"))
    every = F.transform("w", lambda x, i: i if len(begins) > CONFIG_ROWS else F.when(x.isin(begins), i))
    run = lambda i, n: F.when(i + n <= F.size("w"), F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, F.lit(n)), " ").alias("run")))
    none = F.array().cast("array<struct<at:int,run:string>>")
    runs = F.flatten(F.transform(F.array_compact(every), lambda i: F.array_compact(F.array(*[run(i, n) for n in sorted(sizes)])))) if sizes else none
    # The optimizer puts a filter of empty arrays below explode, which works the runs out twice more; explode_outer has no such filter.
    met = texts.select(key, F.explode_outer(runs).alias("r")).filter("r is not null").select(key, "r.at", "r.run")
    if few:
        return met.join(F.broadcast(known), "run").groupBy(key, "term").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    met = met.groupBy(key, "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    return met.join(known, "run").select(key, "term", "n", "first")
