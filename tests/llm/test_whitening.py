"""Whitening against numpy's eigenvectors of the exact covariance matrix."""

import math

import numpy as np
import pytest

from ledgerkit.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, whitened int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in vectors], SCHEMA)


def compare(rows, vectors, most=32):
    kept = [(i, v) for i, v in vectors]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    far = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[float(r[j] - 1_000_000) - (sums[j] - 1_000_000 * n) / n for j in range(d)] for r in x])
    e, vs = np.linalg.eigh(centred.T @ centred / n)
    e, vs = e[::-1], vs[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    assert len(rows) == n * k
    got = np.zeros((n, k))
    at = {}
    for place, (i, _) in enumerate(kept):
        at.setdefault(i, []).append(place)
    for r in sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id or 0)):
        assert r.n == n and 0 <= r.identity_error <= 1e-4 and abs(r.explained - e[r.component - 1] / (sum(far) / n**3)) <= 1e-4 * r.explained
        if len(at[r.vec_id]) == 1:
            assert r.deviation == far[at[r.vec_id][0]]
            got[at[r.vec_id][0], r.component - 1] = r.whitened
    alone = [p for ps in at.values() if len(ps) == 1 for p in ps]
    want = centred @ vs[:, :k] / np.sqrt(e[:k])
    gaps = [c for c in range(k) if min(abs(e[c] - e[o]) for o in range(d) if o != c) > 1e-6 * e[0]]
    for c in gaps:  # within a group of equal eigenvalues any basis will do
        same = got[alone, c] * np.sign(got[alone, c] @ want[alone, c])
        assert np.abs(same - want[alone, c]).max() < 1e-7


@pytest.mark.parametrize("n,d", [(40, 3), (300, 40), (9, 20)])
def test_by_numpy(spark, n, d):
    r = np.random.default_rng(d)
    vectors = [(int(i), (r.normal(size=d) * (1 + np.arange(d)) / d + 3).astype(np.float32).tolist()) for i in range(n)]
    compare(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(whitening.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows_are_dropped_or_kept(spark):
    good = [(i, [i % 5 * 0.25, i % 3 * 1.5, 0.125 * i]) for i in range(20)] + [(None, [0.1, 0.2, 0.3]), (7, [1.0, 1.0, 1.0])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [0.0, float("-inf"), 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == {*range(20), None} and len([r for r in rows if r.vec_id == 7]) == 6
    compare(rows, good)


def test_no_variance_is_an_empty_result(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        df = whitening.whiten(frame(spark, vectors))
        assert df.count() == 0 and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    constant = [(i, [1.0, float(i)]) for i in range(6)]
    assert {r.component for r in whitening.whiten(frame(spark, constant)).collect()} == {1}


def test_large_sums_are_exact():
    y = np.array([[1 << 40, -5], [3, 7]], np.int64)
    assert whitening.deviations(y, 1 << 30, [11, -13]) == [sum(((1 << 30) * int(a) - s) ** 2 for a, s in zip(row, [11, -13])) for row in y]


def test_iterated_solver_agrees(spark, monkeypatch):
    r = np.random.default_rng(5)
    vectors = [(int(i), (r.normal(size=12) * (1 + np.arange(12))).astype(np.float32).tolist()) for i in range(80)]
    monkeypatch.setattr(whitening, "EXACT_DIMENSIONS", 4)
    compare(whitening.Whitening(frame(spark, vectors), most=3).transform(frame(spark, vectors)).collect(), vectors, most=3)
