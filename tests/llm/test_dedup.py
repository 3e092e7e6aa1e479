"""Exact deduplication, n-gram Jaccard join and line join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from conftest_llm import pairs_of

from ledgerkit.llm import exact_dedup, jaccard_join, line_dedup
from ledgerkit.llm.graph import connected_components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def last(doc_id):
    return (doc_id is None, doc_id)


@pytest.mark.parametrize("frame", ["odd", "docs", "near"])
@pytest.mark.parametrize("block", [7, 4096])
def test_exact(frame, block, request):
    docs = request.getfixturevalue(frame)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    want = []
    for t, ids in groups.items():
        ids.sort(key=last)
        want += [(d, ids[0], len(ids), i == 0, hashlib.sha256(t.encode()).hexdigest()) for i, d in enumerate(ids)]
    if frame == "odd" and block == 7:
        docs = docs.filter("length(text) < 1000 or text is null")
        want = [w for w in want if w[0] not in (10, 11, 15)]
    got = [tuple(r) for r in exact_dedup.exact_dedup_report(docs, block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_keeps_columns_and_rows(odd, empty):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted((norm(r.text) for r in kept.collect())) == sorted({norm(r.text) for r in odd.collect()})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.exact_dedup_report(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near_classes(rows):
    sets = [shingles(r.text) for r in rows]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    links = [(i, j) for i, j in pairs_of(by.values()) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root, least = roots(len(rows), links), {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], (True, None)), last(r.doc_id), key=lambda x: (x[0], x[1] or 0))
    return [(r.doc_id, len(sets[i]), least[root[i]][1]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("frame", ["odd", "docs", "near"])
@pytest.mark.parametrize("small", [False, True])
def test_near(frame, small, request, monkeypatch):
    if small:  # large tiles, blocks and frequent shingles at this size
        monkeypatch.setattr(jaccard_join, "TILE_ROWS", 3)
        monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 4)
        monkeypatch.setattr(jaccard_join, "HEAVY_LEAST", 2)
    docs = request.getfixturevalue(frame)
    want = near_classes(docs.collect())
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_keeps_one_of_each(near, empty):
    kept = jaccard_join.drop_near_copies(near)
    assert kept.columns == near.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in near_classes(near.collect())}
    assert jaccard_join.drop_near_copies(empty).count() == 0 and jaccard_join.jaccard_components(empty).count() == 0


def test_bitmap_never_bounds_too_low():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(300):
        pool = r.integers(0, 2**63, 3000).astype(np.uint64)
        a, b = (np.unique(r.choice(pool, r.integers(1, 2500))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        x, y = jaccard_join.parity_bitmap(a), jaccard_join.parity_bitmap(b)
        assert jaccard_join.overlap_bound(x, y, len(a), len(b)) >= both
        assert jaccard_join.overlap_bound(jaccard_join.signature(x), jaccard_join.signature(y), len(a), len(b)) >= both


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    root = roots(400, links)
    least = {}
    for i in range(400):
        least.setdefault(root[i], i)
    want = {n: least[root[n]] for a, b in links if a != b for n in (a, b)}
    got = connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len(want) and {x.node: x.component for x in got} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows):
    """(document, line) pairs that go: lines in order of documents that an earlier line resembles."""
    rows = sorted((r for r in rows if r.text), key=lambda r: r.doc_id)
    lines = [(r.doc_id, i, frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))) for r in rows for i, line in enumerate(r.text.split("\n"))]
    by, out = defaultdict(list), set()
    for d, i, s in lines:
        near = {x for w in s for x in by[w]}
        if any(100 * len(s & x) >= 80 * len(s | x) for x in near):
            out.add((d, i))
        for w in s:
            if s not in by[w]:
                by[w].append(s)
    return out


@pytest.mark.parametrize("tile", [2, 256])
def test_lines(docs, near, spark, tile, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE_ROWS", tile)
    for frame in (docs, near):
        got = line_dedup.line_report(frame).collect()
        assert {(r.doc_id, i) for r in got for i in r.removed} == removed(frame.collect())
        assert all(r.n_removed == len(r.removed) for r in got) and len(got) == frame.count()


def test_lines_odd(odd, empty):
    got = line_dedup.line_report(odd).collect()
    assert len(got) == odd.count()
    assert sum(r.n_removed for r in got if r.doc_id == 8) == 2  # three equal rows
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert sum(r.text == "one two" for r in out.collect()) == 1
    assert line_dedup.line_report(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


def test_lines_text(spark):
    rows = [(1, "a b c d e\n\nkeep this line here"), (2, "A b c d e\nnew words stand alone\n\nlast"), (3, None)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "new words stand alone\n\nlast", 3: None}
