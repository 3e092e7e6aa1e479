"""Embedding whitening: principal components by MLlib's computeSVD on centred distributed rows.

An entry c counts as the integer x = floor(64 c) + 1000000. Sums by dimension are exact integers; the rows are
centred as doubles before anything is multiplied, MLlib finds singular values and right singular vectors, and a
singular value s gives the eigenvalue s * s / n of the covariance with divisor n. The total variance is computed
separately, from the exact deviations of all rows. The offset of x cancels in every deviation, so the code works on
floor(64 c).

Scale: five scans of the vectors and no shuffle of rows. A task sends one row per dimension (or pair of components);
the driver holds the sums and the d by d matrix that computeSVD keeps there. Up to ``EXACT_DIMENSIONS`` dimensions
MLlib solves that matrix to double precision; beyond, it iterates for 32 components to its tolerance of 1e-10.

Defined results: rows whose vector is null or holds a null, a non-finite entry or one of 2**56 or more are dropped;
so are vectors of another length than the most frequent one (of equally many, the longer one). Components whose
standard deviation is under 1e-6 of the largest have no variance to double precision and are left out, so equal rows, a single row or an
empty table give an empty result. A deviation over 2**63 - 1 is null. Repeated rows and null ids are kept each;
further columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that are returned at most.
COMPONENTS = 32
#: Dimensions up to which the driver solves the whole covariance matrix (34 MB).
EXACT_DIMENSIONS = 2048
_LEAST_SPREAD = 1e-6
_LARGE, _LONG = float(1 << 56), (1 << 63) - 1
_HALF = 10**18
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Whether a vector has finite entries only (of less than 2**56, so that x is a long)."""
    return F.coalesce(F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < _LARGE, F.lit(False))), F.lit(False))


def _matrices(batches, column: int):
    """(record batch, floor(64 c) of its vectors as one integer matrix) for each length in each batch."""
    for batch in batches:
        lists = batch.column(column)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            whole = len(rows) == len(sizes)
            entries = values if whole else values[(starts[rows][:, None] + np.arange(d)).ravel()]
            y = np.floor(entries.astype(np.float64).reshape(len(rows), d) * 64).astype(np.int64)
            yield (batch if whole else batch.take(pa.array(rows))), y


def _sums(batches):
    """(length, dimension, sum of floor(64 c), rows) of a task; dimension -1 counts vectors."""
    totals: dict[int, list] = {}
    for batch, y in _matrices(batches, 0):
        d = y.shape[1]
        small = not y.size or int(np.abs(y).max()) * len(y) < 1 << 62
        have = totals.setdefault(d, [0, [0] * d])
        have[0] += len(y)
        have[1] = [a + int(b) for a, b in zip(have[1], (y if small else y.astype(object)).sum(axis=0))]
    for d, (n, sums) in totals.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d] * (d + 1), pa.int32()), "dim": pa.array(range(-1, d), pa.int32()), "total": pa.array([Decimal(n), *map(Decimal, sums)], pa.decimal128(38, 0))})


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row, the sum over dimensions of (n * y - S) squared, exact."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, y.shape[1]) > _LONG:
        apart = y.astype(object) * n - np.array(sums, object)
    else:
        apart = y * n - np.array(sums, np.int64)
    return (apart * apart).sum(axis=1).tolist()


class Whitening:
    """What a fit knows: n, exact sums, mean, the scaled components, explained shares and the identity error."""

    def __init__(self, vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS):
        self.column, self.n, self.sums = column, 0, []
        self.total = Fraction(0)
        self.components = np.zeros((0, 0))
        self.explained = self.eigenvalues = np.zeros(0)
        self.identity_error = 0.0
        kept = vectors.select(column).filter(usable(F.col(column)))
        counts = kept.mapInArrow(_sums, "d int, dim int, total decimal(38,0)").groupBy("d", "dim").agg(F.sum("total").alias("total"))
        lengths = counts.filter("dim = -1").orderBy(F.desc("total"), F.desc("d")).limit(1).collect()
        if not lengths or not lengths[0].d:
            return
        self.n, d = int(lengths[0].total), lengths[0].d
        self.sums = [int(r.total) for r in counts.filter(f"d = {d} and dim >= 0").orderBy("dim").collect()]  # a row for each dimension
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums])
        self.total = self._total(kept) / self.n**3
        if not self.total:
            return
        self._fit(kept, min(most, d))
        self.identity_error = self._identity_error(kept)

    def rows(self, vectors: DataFrame) -> DataFrame:
        return vectors.filter(usable(F.col(self.column)) & (F.size(self.column) == len(self.sums)))

    def _total(self, kept: DataFrame) -> Fraction:
        """The sum of the exact deviations, in two halves that fit decimals."""
        n, sums = self.n, self.sums

        def run(batches):
            total = sum(sum(deviations(y, n, sums)) for _, y in _matrices(batches, 0))
            yield pa.RecordBatch.from_pydict({k: pa.array([Decimal(v)], pa.decimal128(38, 0)) for k, v in (("high", total // _HALF), ("low", total % _HALF))})

        high, low = self.rows(kept).mapInArrow(run, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high"), F.sum("low")).first()
        return Fraction(int(high) * _HALF + int(low))

    def _fit(self, kept: DataFrame, k: int) -> None:
        d = len(self.sums)
        means = F.split(F.lit(",".join(map(repr, self.mean.tolist()))), ",").cast("array<double>")
        centred = F.zip_with(F.col(self.column), means, lambda c, m: F.floor(c.cast("double") * 64).cast("double") - m)
        rows = MLUtils.convertVectorColumnsFromML(self.rows(kept).select(array_to_vector(centred).alias("row")), "row")
        # Asked for all components, MLlib solves the whole matrix instead of iterating.
        svd = RowMatrix(rows, self.n, d).computeSVD(d if d <= EXACT_DIMENSIONS else k, computeU=False, rCond=_LEAST_SPREAD)
        s = svd.s.toArray()[:k]
        self.eigenvalues = s * s / self.n
        self.components = svd.V.toArray()[:, :k]
        self.explained = self.eigenvalues / float(self.total)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ (self.components / np.sqrt(self.eigenvalues))

    def _identity_error(self, kept: DataFrame) -> float:
        """Largest absolute entry of the whitened rows' covariance minus the identity; sums of a task by pair of components."""
        k, n = len(self.eigenvalues), self.n
        at = np.arange(k)

        def run(batches):
            products, sums = np.zeros((k, k)), np.zeros(k)
            for _, y in _matrices(batches, 0):
                w = self.whitened(y)
                products += w.T @ w
                sums += w.sum(axis=0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.r_[np.repeat(at, k), at], pa.int32()), "j": pa.array(np.r_[np.tile(at, k), at * 0 - 1], pa.int32()), "v": np.r_[products.ravel(), sums]})

        found = {(r.i, r.j): r.v / n for r in self.rows(kept).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(k))

    def transform(self, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
        """One row for each remaining vector and component."""
        k, n, sums = len(self.eigenvalues), self.n, self.sums
        rows = self.rows(vectors).select(F.col(key).cast("long"), self.column)
        if not k:
            return rows.sparkSession.createDataFrame([], _RESULT)

        def run(batches):
            for batch, y in _matrices(batches, 1):
                for low in range(0, len(y), 1024):  # a vector becomes k rows
                    part = y[low : low + 1024]
                    m, far = len(part), [x if x <= _LONG else None for x in deviations(part, n, sums)]
                    each = np.repeat(np.arange(m), k)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "vec_id": batch.column(0).slice(low, m).take(pa.array(each)),
                            "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                            "n": np.full(m * k, n, np.int64),
                            "deviation": pa.array(far, pa.int64()).take(pa.array(each)),
                            "whitened": self.whitened(part).ravel(),
                            "explained": np.tile(self.explained, m),
                            "identity_error": np.full(m * k, self.identity_error),
                        }
                    )

        return rows.mapInArrow(run, _RESULT)


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row and component."""
    return Whitening(vectors).transform(vectors)
