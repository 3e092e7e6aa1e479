"""Name suggestions by brute force; steps of flat bills by the reference's rule."""

import datetime
import difflib
import random

import pytest

from ledgerkit.operators import knowledge, series


def brute(query, aliases, cutoff):
    close = sorted((-difflib.SequenceMatcher(None, a, query).ratio(), a) for a in aliases)
    close = [a for r, a in close if -r >= cutoff]
    held = sorted((a for a in aliases if len(a) >= 3 and f" {a} " in f" {query} " and a not in close), key=lambda a: (-len(a), a))
    return (close + held)[:4]


@pytest.mark.parametrize("cutoff", [0.88, 0.8, 0.5])
def test_suggestions_by_brute_force(spark, cutoff):
    r = random.Random(4)
    words = ["starbucks", "shell", "aldi", "oil", "main", "corner", "a", "bb", "banana", "cafe"]
    aliases = sorted({" ".join(r.choices(words, k=r.randrange(1, 4))) for _ in range(50)})
    asked = {"tarbucks", "xstarbucks", "sharbucks", "shell on main st", "shel", "", "b", "bananana"}
    for a in aliases:
        t = list(a)
        for _ in range(r.randrange(1, 4)):
            i = r.choice([0, 0, 1, r.randrange(len(t) + 1)])
            t[i : i + r.randrange(2)] = r.choice(["", "q", "s"])
        asked.add("".join(t))
    got = {}
    q, a = spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame([(x,) for x in aliases], "alias string")
    for row in knowledge.suggestions(q, a, cutoff).orderBy("query", "rank").collect():
        got.setdefault(row.query, []).append(row.alias)
    assert got == {x: b for x in asked if x and (b := brute(x, aliases, cutoff))}


def test_latest_step_need_not_last(spark):
    def steps(cents):
        rows = [(1, i, datetime.date(2026, 1 + i, 1), c) for i, c in enumerate(cents)]
        return [tuple(r)[2:] for r in series.flat_steps(spark.createDataFrame(rows, "account long, id long, day date, cents long")).collect()]

    assert steps([5000, 5000, 6000, 6000, 9000]) == [(5000, 6000)]  # the last payment is one of a kind
    assert steps([5000, 5020, 5040, 6000, 6080, 6060]) == [(5020, 6060)]  # medians
    assert steps([5000, 6000]) == [] and steps([5000, 5000, 5000]) == []
