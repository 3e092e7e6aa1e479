"""Line deduplication by an exact set-similarity join.

A line's set holds its distinct words. Lines of one set are one node, placed at the first of them in the
order of documents (by doc_id) and lines. A line is removed when an earlier line of the corpus, removed
itself or not, has a set of Jaccard similarity 0.8 or more.

The join: words are ordered by rarity, estimated from counts in 2**21 cells that every task shares; any
common order is right, a good one is fast. Two similar sets share one of their first
``n - ceil(0.8 n) + 1`` words, so nodes meet in tiles of such words only. Of nodes that meet, those pass whose
sizes, positions and parity signatures allow the similarity; it is then verified on the words.

A node goes when a single earlier one is similar, so it needn't meet all. First each node is verified against the
earlier node of each tile whose signature is nearest; its other candidates are only listed. Nodes that are still
there are then verified against all of their lists. A group of near copies thus costs pairs in proportion to its nodes.

Scale: equal lines are joined by an aggregation that combines map-side, so a line of a third of all rows
costs one node. Tiles of up to ``TILE_ROWS`` are compared inside a task. Of larger tiles nodes are compared
with the tile's first ones and their neighbours; what is left becomes a shuffled join on word and size
band. Tiles of very frequent words are salted, so that no task has a whole one.

Defined results: null text has no lines; blank lines are kept; repeated rows repeat their lines, of
which the first stays; where doc_ids repeat or are null, documents come in the order they are read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import BROADCAST_ROWS, discard, keyed, limited, materialise
from ledgerkit.llm.words import bytes_of, chunks, distinct, line_words, mix

PERCENT = 80
CELL_BITS = 21
TILE_ROWS = 256
#: Rows of a large tile that each of its rows is compared with, beside its neighbours.
LEADERS = 32
#: Occurrences of a word from which on its tile is salted into parts of about as many.
HOT = 100_000
#: Bits of the bitmaps that pairs are compared by before their sets are.
BITMAP_BITS = 512
#: Sets of more words have a second signature.
_WIDE = 24
_MASK = np.uint64((1 << CELL_BITS) - 1)
_POST = ["tile", "k", "line", "n", "at", "sig", "wide"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _sets(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (key, text) the lines with a word: row, number, sorted distinct word hashes, where each line's begin, how many they are."""
    words, bounds, row, line = line_words(batch.column(1))
    s, g = distinct(words, np.repeat(np.arange(len(row)), np.diff(bounds)))
    n = np.bincount(g, minlength=len(row))
    return row, line, s, np.r_[0, np.cumsum(n)[:-1]].astype(np.int64), n


def _signatures(s: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the sets' words in 64 places, and for larger sets in 64 others: they differ in as many places at most as the sets in words."""
    one = np.uint64(1)
    sig = np.bitwise_xor.reduceat(one << (s >> np.uint64(40) & np.uint64(63)), starts)
    second = s >> np.uint64(46) & one
    low = np.bitwise_xor.reduceat((one - second) << (s >> np.uint64(40) & np.uint64(63)), starts)
    high = np.bitwise_xor.reduceat(second << (s >> np.uint64(40) & np.uint64(63)), starts)
    wide = n > _WIDE
    return np.where(wide, low, sig).view(np.int64), np.where(wide, high, 0).astype(np.uint64).view(np.int64)


def _identity(s: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, independent of order."""
    with np.errstate(over="ignore"):
        return [np.add.reduceat(mix(s ^ np.uint64(c)), starts).view(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


_HASHES = "cell int, k long, line int, h1 long, h2 long"


def _hashes(batches):
    """A row for each line with a word: key, line, two hashes of the set; then the cells of the table of frequent words (k: count here)."""
    cells = np.zeros(1 << CELL_BITS, np.int32)
    for batch in chunks(batches, 1):
        row, line, s, starts, _ = _sets(batch)
        np.add.at(cells, (s & _MASK).astype(np.int64), 1)
        if len(row):
            cols = [pa.nulls(len(row), pa.int32()), batch.column(0).take(pa.array(row)), pa.array(line.astype(np.int32)), *map(pa.array, _identity(s, starts))]
            yield pa.RecordBatch.from_arrays(cols, names=["cell", "k", "line", "h1", "h2"])
    often = np.flatnonzero(cells > 1)
    for at in range(0, len(often), 100_000):
        some = often[at : at + 100_000]
        nulls = [pa.nulls(len(some), t) for t in (pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells[some].astype(np.int64)), *nulls], names=["cell", "k", "line", "h1", "h2"])


def _lines(counts):
    """A row for each line with a word: key, line, two hashes of the set, its size, signatures and prefix."""

    def run(batches):
        for batch in chunks(batches, 1):
            row, line, s, starts, n = _sets(batch)
            if not len(row):
                continue
            group = np.repeat(np.arange(len(n)), n)
            often = counts.value[(s & _MASK).astype(np.int64)]
            order = np.argsort(group.astype(np.uint64) << np.uint64(32) | often.astype(np.uint64), kind="stable")  # hashes ascend already
            take = n - (PERCENT * n + 99) // 100 + 1
            first = order[np.arange(len(s)) - np.repeat(starts, n) < np.repeat(take, n)]
            # A tile is a word and the number of parts that its rows are dealt to.
            tile = (s[first] >> np.uint64(32) << np.uint64(32)).view(np.int64) | (often[first] // HOT).astype(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(tile))
            cols = [batch.column(0).take(pa.array(row)), pa.array(line.astype(np.int32)), *map(pa.array, _identity(s, starts)), pa.array(n.astype(np.int32)), *map(pa.array, _signatures(s, starts, n)), prefix]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "line", "h1", "h2", "n", "sig", "wide", "first"])

    return run


class _Tiles:
    """Rows of posts, with ``group``: rows of one group are compared with each other."""

    def __init__(self, cols: list[np.ndarray], group: np.ndarray):
        self.cols, self.group = cols, group
        self.tile, self.k, self.line, n, at, self.sig, self.wide = cols
        self.n, self.at = n.astype(np.int64), at.astype(np.int64)

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(later, earlier, places in which signatures differ) of those pairs of rows that may be similar."""
        n, m = self.n[i], self.n[j]
        both = n + m
        # Two words of a line may share the 32 bits of a tile: a line doesn't meet itself.
        ok = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((self.k[i] != self.k[j]) | (self.line[i] != self.line[j]))
        ok &= (100 + PERCENT) * np.minimum(n - self.at[i], m - self.at[j]) >= PERCENT * both
        i, j, both, alike = i[ok], j[ok], both[ok], ((n > _WIDE) == (m > _WIDE))[ok]
        differ = np.bitwise_count((self.sig[i] ^ self.sig[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((self.wide[i] ^ self.wide[j]).view(np.uint64))
        differ[~alike] = 0
        ok = (100 + PERCENT) * (both - differ) >= 2 * PERCENT * both
        i, j, differ = i[ok], j[ok], differ[ok]
        later = (self.k[i] > self.k[j]) | ((self.k[i] == self.k[j]) & (self.line[i] > self.line[j]))
        return np.where(later, i, j), np.where(later, j, i), differ

    def pairs(self):
        """Pairs of rows of a group, in pieces: every row with those that are larger, but not too large."""
        order = np.lexsort((self.n, self.group))
        group, n = self.group[order], self.n[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        ends, here = np.repeat(starts + sizes, sizes), np.arange(len(group))
        for step in range(1, int(sizes.max(initial=0))):
            here = here[here + step < ends[here]]
            here = here[100 * n[here] >= PERCENT * n[here + step]]
            if not len(here):
                return
            yield order[here], order[here + step]

    def rows(self, which: np.ndarray, *more: np.ndarray) -> list[pa.Array]:
        return [*(pa.array(c[which]).cast(t) for c, t in zip(self.cols, _TYPES)), *map(pa.array, more)]


def _stream(batches):
    """Rows sorted by tile and place, in pieces of at most ``TILE_ROWS`` rows of a tile.

    Yields (columns, number of each row's piece, whether its tile is large, row of its tile's first row); the first
    rows of a tile that goes on are given again, as piece -1. Large are tiles of several pieces, and parts of tiles.
    """
    held, lead, seen = None, None, 0
    for batch in _and_none(batches):
        if batch is not None:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
        else:
            cols = held
        if cols is None or not len(cols[0]):
            continue
        at = np.arange(len(cols[0]))
        new = np.r_[True, cols[0][1:] != cols[0][:-1]]
        tile = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        place = at - first[tile]
        place[tile == 0] += seen
        begins = new | (place % TILE_ROWS == 0)
        large = (np.maximum.reduceat(place, first) >= TILE_ROWS) | (cols[0][first] & 0xFFFFFFFF > 0)
        cut = len(at) if batch is None else int(np.flatnonzero(begins)[-1])
        if cut:
            extra = 0 if lead is None else len(lead[0])
            given = [c[:cut] if lead is None else np.concatenate([x, c[:cut]]) for c, x in zip(cols, lead or cols)]
            head = first[tile[:cut]] + extra
            head[tile[:cut] == 0] = 0
            yield given, np.r_[np.full(extra, -1), np.cumsum(begins[:cut])], np.r_[np.full(extra, True), large[tile[:cut]]], np.r_[np.zeros(extra, np.int64), head]
        if batch is not None:
            begun = int(place[cut])
            if not begun:
                lead, seen = None, 0
            elif tile[cut] or lead is None:
                lead, seen = [c[first[tile[cut]] :][:LEADERS] for c in cols], begun
            else:
                seen = begun
            held = [c[cut:] for c in cols]


def _and_none(batches):
    yield from batches
    yield None


_MET = ["kind", *_POST, "xk", "xline", "more_k", "more_line"]
_MET_SCHEMA = "kind int, tile long, k long, line int, n int, at int, sig long, wide long, xk long, xline int, more_k array<long>, more_line array<int>"


def _meet(batches):
    """For each row the nearest earlier one that it may be similar to, and the tile's others (kind 0); all rows of large tiles (kind 1)."""
    for cols, piece, large, head in _stream(batches):
        t = _Tiles(cols, piece)
        own = np.flatnonzero(piece >= 0)

        def leaders():
            on = own[large[own]]
            for step in range(LEADERS):
                x = head[on] + step
                ok = x < on
                x, y = x[ok], on[ok]
                ok = head[x] == head[y]
                yield x[ok], y[ok]

        within = _Tiles([c[own] for c in cols], piece[own])
        found = [t.close(i, j) for i, j in (*((own[a], own[b]) for a, b in within.pairs()), *leaders())]
        y, x, differ = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ())))
        order = np.lexsort((differ, y))
        y, x = y[order], x[order]
        nearest = np.r_[True, y[1:] != y[:-1]][: len(y)]
        row, best = y[nearest], x[nearest]
        # What a large tile's row has beside the nearest is found again from the rows of kind 1.
        listed = ~nearest & ~large[y]
        counts = np.bincount(y[listed], minlength=len(piece))[row]
        ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        others = [pa.ListArray.from_arrays(ends, pa.array(c[x[listed]].astype(ty))) for c, ty in ((t.k, np.int64), (t.line, np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), np.int32)), *t.rows(row, t.k[best], t.line[best].astype(np.int32)), *others], names=_MET)
        rows = own[large[own]]
        if len(rows):
            none = [pa.nulls(len(rows), ty) for ty in (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), np.int32)), *t.rows(rows), *none], names=_MET)


def _wanted(batches):
    """The sets of a document's wanted lines. batches: k, text, wanted."""
    for batch in chunks(batches, 1):
        row, line, s, starts, n = _sets(batch)
        wanted = batch.column(2)
        ask = np.repeat(np.arange(len(wanted)), np.diff(np.asarray(wanted.offsets))) << 32 | np.asarray(wanted.flatten()).astype(np.int64)
        some = np.isin(row << 32 | line, ask)
        raw = s.tobytes()
        data = [raw[8 * a : 8 * (a + c)] for a, c in zip(starts[some].tolist(), n[some].tolist())]
        maps = [_bitmap(s[a : a + c]) for a, c in zip(starts[some].tolist(), n[some].tolist())]
        cols = [batch.column(0).take(pa.array(row[some])), pa.array(line[some].astype(np.int32)), pa.array(n[some].astype(np.int32)), pa.array(maps, pa.binary()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["k", "line", "n", "bits", "s"])


def _bitmap(s: np.ndarray) -> bytes:
    """Parities of a set's words in ``BITMAP_BITS`` places."""
    bits = np.bincount((s >> np.uint64(20) & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _near(batches):
    """Of rows (k, line, xk, xline, n, xn, bits, xbits) the pairs that the bitmaps leave."""
    for batch in batches:
        n, m = (c.to_numpy().astype(np.int64) for c in batch.columns[4:6])
        x, y = (bytes_of(c)[0].view(np.uint64).reshape(len(n), -1) for c in batch.columns[6:])
        differ = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
        yield batch.select([0, 1, 2, 3]).filter(pa.array((100 + PERCENT) * (n + m - differ) >= 2 * PERCENT * (n + m)))


def _similar(batches):
    """Of rows (k, line, one set, another set) those whose sets are similar."""
    for batch in batches:
        sets, group, sizes = [], [], []
        for c in (2, 3):
            data, offsets = bytes_of(batch.column(c))
            n = np.diff(offsets) // 8
            sets.append(data.view(np.uint64))
            group.append(np.repeat(np.arange(len(n)), n))
            sizes.append(n)
        s, g = np.concatenate(sets), np.concatenate(group)
        order = np.lexsort((s, g))
        s, g = s[order], g[order]
        both = np.bincount(g[1:][(s[1:] == s[:-1]) & (g[1:] == g[:-1])], minlength=len(batch))
        ok = 100 * both >= PERCENT * (sizes[0] + sizes[1] - both)
        yield batch.select([0, 1]).filter(pa.array(ok))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (k, line, xk, xline) the distinct (k, line) whose sets are similar to that of (xk, xline)."""
    ends = pairs.select("k", "line").unionByName(pairs.select(F.col("xk").alias("k"), F.col("xline").alias("line")))
    wanted = materialise(ends.groupBy("k").agg(F.collect_set("line").alias("wanted")), "line-wanted")
    sets = materialise(texts.join(limited(wanted), "k").select("k", "text", "wanted").mapInArrow(_wanted, "k long, line int, n int, bits binary, s binary"), "line-sets")

    def joined(pairs: DataFrame, *columns: str) -> DataFrame:
        x = sets.select(F.col("k").alias("xk"), F.col("line").alias("xline"), *[F.col(c).alias(f"x{c}") for c in columns])
        y = sets.select("k", "line", *columns)
        if pairs.count() <= BROADCAST_ROWS:  # lines that no pair asks for aren't shuffled
            y = y.join(F.broadcast(pairs.select("k", "line")), ["k", "line"], "left_semi")
        return pairs.join(x, ["xk", "xline"]).join(y, ["k", "line"])

    # Bitmaps leave few pairs for the sets, which are several times as wide.
    near = joined(pairs, "n", "bits").select("k", "line", "xk", "xline", "n", "xn", "bits", "xbits")
    near = materialise(near.mapInArrow(_near, "k long, line int, xk long, xline int"), "line-near")
    out = materialise(joined(near, "s").select("k", "line", "s", "xs").mapInArrow(_similar, "k long, line int").distinct(), "line-late")
    discard(wanted, sets, near)
    return out


def removed_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(lines to remove: k, line; keyed documents; name of their key)."""
    spark = docs.sparkSession
    docs, key = keyed(docs)
    texts = docs.select(F.col(key).alias("k"), "text")
    hashes = materialise(texts.mapInArrow(_hashes, _HASHES), "line-hashes")
    table = np.zeros(1 << CELL_BITS, np.int32)
    for r in hashes.filter("cell is not null").groupBy("cell").agg(F.sum("k").alias("n")).toLocalIterator():  # at most 2**CELL_BITS rows
        table[r.cell] = min(r.n, 2**31 - 1)
    counts = spark.sparkContext.broadcast(table)
    lines = texts.mapInArrow(_lines(counts), "k long, line int, h1 long, h2 long, n int, sig long, wide long, first array<long>")
    # The first line of each set, in document order; its figures are the set's, whichever line gives them.
    nodes = lines.groupBy("h1", "h2").agg(F.min(F.struct("k", "line")).alias("start"), *[F.first(c).alias(c) for c in ("n", "sig", "wide", "first")])
    posts = nodes.select(F.posexplode("first").alias("at", "tile"), "start", "n", "sig", "wide")
    parts = F.col("tile").bitwiseAND(F.lit(0xFFFFFFFF))
    tile = F.when(parts == 0, F.col("tile")).otherwise(F.col("tile") - parts + 1 + F.pmod(F.xxhash64("start"), F.when(parts == 0, 1).otherwise(parts)))
    posts = posts.select(tile.alias("tile"), "start.k", "start.line", "n", "at", "sig", "wide")
    met = materialise(posts.repartition("tile").sortWithinPartitions("tile", "k", "line").mapInArrow(_meet, _MET_SCHEMA), "line-met")
    pairs = materialise(met.filter("kind = 0").select("k", "line", "xk", "xline").distinct(), "line-pairs")
    late = _verified(texts, pairs)
    # What is still there meets the rest of its candidates: those listed, and in large tiles all earlier rows of a like size.
    still = F.broadcast(late) if late.count() <= BROADCAST_ROWS else late
    listed = met.filter("kind = 0 and size(more_k) > 0").join(still, ["k", "line"], "left_anti")
    listed = listed.select("k", "line", F.explode(F.arrays_zip("more_k", "more_line")).alias("x")).select("k", "line", F.col("x.more_k").alias("xk"), F.col("x.more_line").alias("xline"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int")
    large = met.filter("kind = 1").select(F.shiftright("tile", 32).alias("h"), *_POST, band.alias("band"))
    near = F.array("band", F.col("band") - 1, F.col("band") - 2, F.col("band") + 1, F.col("band") + 2)
    wide = (
        large.join(still, ["k", "line"], "left_anti").withColumn("band", F.explode(near)).alias("y")
        .join(large.alias("x"), ["h", "band"])
        .filter("(x.k < y.k or (x.k = y.k and x.line < y.line)) and 100 * least(x.n, y.n) >= {0} * greatest(x.n, y.n)".format(PERCENT))
        .filter(f"{100 + PERCENT} * least(x.n - x.at, y.n - y.at) >= {PERCENT} * (x.n + y.n)")
        .filter(f"(x.n > {_WIDE}) <> (y.n > {_WIDE}) or {100 + PERCENT} * (x.n + y.n - bit_count(x.sig ^ y.sig) - bit_count(x.wide ^ y.wide)) >= {2 * PERCENT} * (x.n + y.n)")
        .select("y.k", "y.line", F.col("x.k").alias("xk"), F.col("x.line").alias("xline"))
    )
    rest = materialise(listed.unionByName(wide).distinct(), "line-rest")
    late = late.unionByName(_verified(texts, rest)).distinct()
    # All lines of a node but its first go; the first goes when an earlier node is similar.
    narrow = hashes.filter("cell is null").select("k", "line", "h1", "h2")
    many = materialise(narrow.groupBy("h1", "h2").agg(F.min(F.struct("k", "line")).alias("start"), F.count("*").alias("lines")).filter("lines > 1").select("h1", "h2", "start"), "line-many")
    copies = narrow.join(limited(many), ["h1", "h2"]).filter(F.struct("k", "line") != F.col("start")).select("k", "line")
    out = materialise(late.unionByName(copies), "line-removed")
    discard(met, pairs, rest, hashes, many)
    return out, docs, key


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers from 0)."""
    gone, docs, key = removed_lines(docs)
    per = gone.groupBy("k").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    rows = docs.select(F.col(key).alias("k"), "doc_id", n.cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(per, "k", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their removed lines taken out of text."""
    columns = docs.columns
    gone, docs, key = removed_lines(docs)
    per = gone.groupBy("k").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("k", key)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = docs.join(per, key, "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    return out.select(*[F.col(f"`{c}`") for c in columns])
