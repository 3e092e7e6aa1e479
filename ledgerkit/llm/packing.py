"""Best-fit packing of tokenised documents by length patterns and non-negative least squares.

Documents become pieces of at most ``CAPACITY`` tokens: of a longer document all pieces but the first
are full. Only the histogram of piece lengths, at most ``CAPACITY`` numbers, is planned with: patterns
of two to ``MOST_IN_PATTERN`` lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what is left is packed best
fit, longest first, again on counts. The plan says which ranks among the pieces of a length go to which
run of sequences; each piece finds its place from its rank.

Scale: the plan's size depends on the capacity, not on the rows. Ranks come from counts by partition and
length, so the pieces of a hot length are numbered in all partitions at once, without a shuffle of rows.
Pieces (ids, lengths and checksums, no text) are written out once, which fixes their order.

Defined results: null text is empty and packs as its end id alone; repeated rows are packed each; an
empty table gives an empty result; ties between equal lengths fall to the written order.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.llm.common import discard, materialise
from ledgerkit.llm.tokens import CHUNK, TOKENIZER, encoder
from ledgerkit.llm.words import chunks

CAPACITY = 1024
END_ID = 2
MOST_IN_PATTERN = 4
#: Patterns that the fit may use.
MOST_PATTERNS = 4000
_FIT_ROUNDS = 300


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity if n is over it."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(name: str, capacity: int, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in chunks(batches, 1, CHUNK, keep=True):
            coded, bounds = encoder(name).column(batch.column(1))
            raw, bounds = memoryview(coded.astype("<u4").tobytes()), bounds.tolist()
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                at, n = 4 * bounds[i], bounds[i + 1] - bounds[i]
                for piece, (start, length) in enumerate(cut(n + 1, capacity)):
                    last = start + length > n  # the end id comes after the text's own
                    crc = zlib.crc32(raw[at + 4 * start : at + 4 * (start + length - last)])
                    rows.append((doc_id, piece, start, length, zlib.crc32(end, crc) if last else crc, part, seen[length]))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def patterns(histogram: np.ndarray, capacity: int, most: int = MOST_PATTERNS, width: int = MOST_IN_PATTERN) -> list[tuple[int, ...]]:
    """Multisets of 2..width occurring lengths that sum to the capacity, those of frequent lengths first."""
    there = histogram > 0
    lengths = [int(x) for x in np.flatnonzero(there)]
    out = [(capacity - x, x) for x in lengths if 2 * x <= capacity and x < capacity and there[capacity - x]]
    often = sorted(lengths, key=lambda x: (-histogram[x], x))
    tails: list[tuple[int, ...]] = [(x,) for x in often]
    for size in range(3, width + 1):
        # A pattern of `size` is a tail of frequent lengths, one more length, and the length that is left.
        share, made = out, []
        room = (most - len(share)) // (width + 1 - size)
        for tail in tails:
            for x in often[:64]:
                if x > tail[-1]:
                    continue
                left = capacity - sum(tail) - x
                if 0 < left <= capacity and there[left] and left >= tail[0]:
                    made.append((left, *tail, x))
            if len(made) >= room:
                break
        out = share + made[:room]
        tails = [(*t, x) for t in tails[:64] for x in often[:32] if x <= t[-1] and sum(t) + x < capacity][:2048]
    return [tuple(sorted(p, reverse=True)) for p in dict.fromkeys(tuple(sorted(p)) for p in out)]


def fit_counts(histogram: np.ndarray, pats: list[tuple[int, ...]], rounds: int = _FIT_ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise |A x - h|: coordinate descent on the non-negative least squares problem."""
    h = histogram.astype(float)
    use = [np.unique(p, return_counts=True) for p in pats]
    norms = np.array([float((c * c).sum()) for _, c in use])
    x, left = np.zeros(len(pats)), h.copy()
    for _ in range(rounds):
        moved = 0.0
        for j, (ls, cs) in enumerate(use):
            step = max(-x[j], float((cs * left[ls]).sum()) / norms[j])
            if step:
                x[j] += step
                left[ls] -= step * cs
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    # Rounded down, and lowered where overlapping patterns together ask for more than there is.
    left, whole = histogram.astype(np.int64).copy(), np.zeros(len(pats), np.int64)
    for j in np.argsort(-x, kind="stable"):
        ls, cs = use[j]
        whole[j] = min(int(x[j] + 1e-9), int((left[ls] // cs).min()))
        left[ls] -= whole[j] * cs
    return whole


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: (lengths of a sequence, how many such sequences)."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    for length in range(capacity, 0, -1):
        n = int(histogram[length])
        for room in range(length, capacity + 1):
            while n and open_[room]:
                pattern, bins = next(iter(open_[room].items()))
                take = min(n, bins)
                open_[room].pop(pattern)
                if bins > take:
                    open_[room][pattern] = bins - take
                wider = (*pattern, length)
                open_[room - length][wider] = open_[room - length].get(wider, 0) + take
                n -= take
                if room - length >= length:  # the bins just filled are now the best fit
                    return_to = room - length
                    while n and open_[return_to].get(wider) and return_to >= length:
                        bins = open_[return_to].pop(wider)
                        take = min(n, bins)
                        if bins > take:
                            open_[return_to][wider] = bins - take
                        wider, return_to = (*wider, length), return_to - length
                        open_[return_to][wider] = open_[return_to].get(wider, 0) + take
                        n -= take
        if n:
            per = capacity // length
            full, rest = divmod(n, per)
            if full:
                open_[capacity - per * length][(length,) * per] = open_[capacity - per * length].get((length,) * per, 0) + full
            if rest:
                open_[capacity - rest * length][(length,) * rest] = open_[capacity - rest * length].get((length,) * rest, 0) + 1
    return [(p, n) for bins in open_.values() for p, n in bins.items()]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram."""
    left = histogram.astype(np.int64).copy()
    out = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    pats = patterns(left, capacity)
    if pats:
        for p, n in zip(pats, fit_counts(left, pats)):
            if n:
                out.append((p, int(n)))
                ls, cs = np.unique(p, return_counts=True)
                left[ls] -= n * cs
    return out + best_fit(left, capacity)


def places(sequences: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of ranks by length: pieces of `length` with rank >= `rank` go to sequence `sequence + rank - run's rank` at `offset`."""
    used = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for lengths, n in sequences:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    pieces = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, capacity, end_id), schema), "pack-pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r.length] = r.n
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity), capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))

    def place(batches):
        w = where.value
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            key = w["length"] * (1 << 40) + w["rank"]
            run = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(w["sequence"][run] + rank - w["rank"][run]), pa.array(w["offset"][run])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
