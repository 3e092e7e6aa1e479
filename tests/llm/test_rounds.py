"""Few shuffles: each that a driver has begun within a minute keeps a thread and its memory there."""

import random

import pytest

from ledgerkit.llm import exact_dedup
from ledgerkit.llm.graph import connected_components


def jobs(spark, what, run):
    """Result of ``run`` and the number of Spark jobs (one for each shuffle or broadcast, under adaptive execution)."""
    try:
        spark.sparkContext.setJobGroup(what, what)
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(what))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def chains(n):
    r = random.Random(n)
    names = list(range(n))
    r.shuffle(names)
    at, want, links = 0, {}, []
    while at < n:
        chain = names[at : at + r.randrange(2, 60)]
        at += len(chain)
        if len(chain) > 1:
            want |= dict.fromkeys(chain, min(chain))
            links += [p if r.random() < 0.5 else p[::-1] for p in zip(chain, chain[1:])]
    r.shuffle(links)
    return links, want


@pytest.mark.parametrize("walk", [1, 37, 10_000])
def test_components_by_rounds_and_walk(spark, walk):
    links, want = chains(800)
    want |= dict.fromkeys(range(5001, 5300), 5001)
    hub = [(5001, 5000 + i) for i in range(2, 300)]
    got = connected_components(spark.createDataFrame(links + hub + links[:50] + [(9, 9)], "u long, v long"), walk).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_few_edges_need_few_jobs(spark):
    links, want = chains(800)
    edges = spark.createDataFrame(links, "u long, v long")
    got, n = jobs(spark, "few-edges", lambda: connected_components(edges).collect())
    assert len(got) == len(want) and n <= 5


def test_long_texts_need_few_jobs(spark):
    """Texts of 100 and 130 blocks: two rounds of names instead of seven or eight."""
    texts = [(i, " ".join(f"w{(i // 2) * 31 + j % 501}" for j in range(1600 + 400 * (i % 4 // 2)))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got, n = jobs(spark, "long-texts", lambda: exact_dedup.exact_dedup_report(docs, 64).collect())
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, i // 2 * 2, 2) for i in range(12)]
    assert n <= 60, n
