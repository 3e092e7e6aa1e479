"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents of one and the
same set (compared by 128 bits) are one node. Two nodes link when 100 * |A and B| >= 80 * |A or B|.

1. One scan gives each document's set size, set hash, a parity bitmap of its set and a few min-hashes.
   The bitmap's width follows the size band. As bits are parities, ``popcount(a xor b)`` never exceeds
   the symmetric difference, so ``(|A| + |B| - popcount) / 2`` bounds the overlap from above.
2. Documents of one min-hash are compared with one leader, the one whose min-hashes are shared most (in a
   group of near copies that is close to what they were copied from); links found join most copies of a
   large group with few comparisons. This only saves work: nothing is decided by a failed comparison.
3. For the rest the prefix principle is exact: in any common order of shingles two linked sets share
   one of their first ``n - ceil(0.8 n) + 1``. The order puts frequent shingles last, so a passage that
   many documents share rarely makes a tile. A tile holds the nodes of one prefix shingle, sorted by
   size; only pairs within the size band and the positional bound that aren't linked yet go on.
   Shingles of more nodes than ``TILE_ROWS`` whose nodes are all linked already need nothing more. For the
   others each node is first compared with ``HUBS`` random nodes of its largest such shingle, a few times
   over: members of one group of near copies end in one component by comparisons in proportion to the
   group. The nodes of what is still mixed are dealt to blocks of about ``BLOCK_NODES``, and pairs of
   blocks are compared by parity bitmaps, so that a pair of rows exists only where the bound lets a link be.
4. Surviving pairs pass the bitmap bound, then sorted arrays are intersected exactly.
5. Links become components by star contraction.

Nothing is capped: the size of tiles and the frequent-shingle table decide the way, not the result.

Defined results: null or wordless text has an empty set and is a component of its own; fewer than five
words make one shingle of the whole sequence; a null doc_id stays null and is never a component's
smallest unless all are null; repeated rows link like other copies; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import discard, keyed, materialise, sized_join, slices
from ledgerkit.llm.graph import connected_components
from ledgerkit.llm.shingles import shingle_sets
from ledgerkit.llm.words import chunks

#: Linked from this similarity on, in hundredths.
PERCENT = 80
#: A prefix shingle of more nodes than this is joined outside of the in-task tile.
TILE_ROWS = 256
#: Nodes of a block of such a shingle.
BLOCK_NODES = 4096
#: Random nodes that each node of such a shingle meets first, and how often at most.
HUBS, HUB_ROUNDS = 16, 3
#: 64-bit words of the signature that block pairs compare.
SIGNATURE_WORDS = 8
#: Bits that index the table of frequent shingles: 2**20 counts, 8 MB, whatever the input.
HEAVY_BITS = 20
#: A partition reports a cell of that table from this count on, and from this multiple of the mean.
HEAVY_LEAST, HEAVY_TIMES = 8, 6
#: Multipliers of the min-hashes.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Bitmap widths in 64-bit words: 4 bits for each shingle, as a power of two between these.
BITMAP_WORDS_LEAST, BITMAP_WORDS_MOST = 8, 128


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit i is the parity of the number of hashes that fall on it; the width is a power of two."""
    words = BITMAP_WORDS_LEAST
    while words < BITMAP_WORDS_MOST and words * 64 < 4 * len(hashes):
        words *= 2
    bits = np.bincount(((hashes >> np.uint64(20)) & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """At least the overlap of the two sets; the wider bitmap is folded onto the other's width."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    differ = int(np.bitwise_count(x ^ y).sum())
    return (na + nb - differ) // 2


def signature(bitmap: bytes) -> bytes:
    """The bitmap folded to SIGNATURE_WORDS words (none is narrower); its bits still are parities."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, SIGNATURE_WORDS), axis=0).tobytes()


def linked(overlap, na, nb):
    return 100 * overlap >= PERCENT * (na + nb - overlap)


def _profile(batches):
    """Rows of kind 0: a document; kind 1: a cell of the table of frequent shingles, with its count here."""
    cells, total = np.zeros(1 << HEAVY_BITS, np.int32), 0
    mask = np.uint64((1 << HEAVY_BITS) - 1)
    for batch in chunks(batches, 2):
        every, bounds = shingle_sets(batch.column(2))
        np.add.at(cells, (every & mask).astype(np.int64), 1)
        total += len(every)
        full = np.flatnonzero(np.diff(bounds))
        starts = bounds[full]
        h1, h2, lows = [0] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows
        if len(full):
            with np.errstate(over="ignore"):
                h1, h2 = np.zeros((2, batch.num_rows), np.uint64)
                h1[full] = np.bitwise_xor.reduceat((every ^ (every >> np.uint64(29))) * _MULTIPLIERS[0], starts)
                h2[full] = np.add.reduceat((every ^ (every >> np.uint64(32))) * _MULTIPLIERS[1], starts)
                low = np.stack([np.minimum.reduceat(every * m, starts) for m in _MULTIPLIERS], axis=1)
            h1, h2 = h1.view(np.int64).tolist(), h2.view(np.int64).tolist()
            for i, x in zip(full.tolist(), (low ^ np.uint64(1 << 63)).view(np.int64).tolist()):
                lows[i] = x
        at = bounds.tolist()
        maps = [parity_bitmap(every[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
        ids = [c.to_pylist() for c in batch.columns[:2]]
        yield _profile_batch(list(zip([0] * batch.num_rows, *ids, np.diff(bounds).tolist(), h1, h2, maps, lows)))
    least = max(HEAVY_LEAST, HEAVY_TIMES * total / len(cells))
    hot = np.flatnonzero(cells >= least)
    for at in range(0, len(hot), 50_000):
        yield _profile_batch([(1, int(c), None, int(cells[c]), 0, 0, None, None) for c in hot[at : at + 50_000]])


_PROFILE = "kind int, k long, doc_id long, n long, h1 long, h2 long, bitmap binary, low array<long>"


def _profile_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, ks, ids, ns, h1, h2, maps, lows = zip(*rows) if rows else ([],) * 8
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    columns = [kinds, ks, ids, ns, h1, h2, maps, lows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "k", "doc_id", "n", "h1", "h2", "bitmap", "low"])


def prefix_of(s: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n - ceil(0.8 n) + 1`` of a sorted set, rare shingles first, and which of them are frequent."""
    take = len(s) - (PERCENT * len(s) + 99) // 100 + 1
    if not weight.any():
        return s[:take], np.zeros(take, bool)
    order = np.lexsort((s, weight))[:take]
    return s[order], weight[order] > 0


def _prefixes(heavy):
    def run(batches):
        counts, mask = heavy.value, np.uint64((1 << HEAVY_BITS) - 1)
        for batch in chunks(batches, 1):
            every, bounds = shingle_sets(batch.column(1))
            often, at = counts[(every & mask).astype(np.int64)], bounds.tolist()
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                first, hot = zip(*(prefix_of(every[at[i] : at[i + 1]], often[at[i] : at[i + 1]]) for i in full.tolist()))
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in first])], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hot)))], names=["k", "first", "hot"])

    return run


def _tiles(batches):
    """Rows sorted by shingle come in; pairs of a tile go out (kind 0), or the rows of a large tile (kind 1)."""
    names = ["kind", "h", "a", "b", "n", "comp", "at"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def out(kind, h, a, b, n, comp, at):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(x, len(a)), t) for x, t in zip((kind, h, a, b, n, comp, at), types)], names=names)

    def apart(h, k, n, comp, at):
        return out(1, h, k, 0, n, comp, at)

    def close(h, k, n, comp, at):
        """Whole tiles come in."""
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        big = np.repeat(sizes > TILE_ROWS, sizes)
        if big.any():
            yield apart(h[big], k[big], n[big], comp[big], at[big])
        keep = np.repeat((sizes > 1) & (sizes <= TILE_ROWS), sizes)
        h, k, n, comp, at = (x[keep] for x in (h, k, n.astype(np.int64), comp, at))
        if not len(h):
            return
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        ends, here, found = np.repeat(starts + sizes, sizes), np.arange(len(h)), []
        for step in range(1, TILE_ROWS):
            here = here[here + step < ends[here]]
            # Sorted by size: what has left the band is no longer met.
            here = here[100 * n[here] >= PERCENT * n[np.minimum(here + step, len(h) - 1)]]
            if not len(here):
                break
            i, j = here, here + step
            ok = (comp[i] != comp[j]) & ((100 + PERCENT) * np.minimum(n[i] - at[i], n[j] - at[j]) >= PERCENT * (n[i] + n[j]))
            found.append(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])])[:, ok])
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0))
        if pairs.shape[1]:
            yield out(0, 0, pairs[0], pairs[1], 0, 0, 0)

    rest, large = None, None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if large is not None and len(cols[0]):
            same = cols[0] == large
            if same.any():
                yield apart(*(c[same] for c in cols))
                cols = [c[~same] for c in cols]
            if len(cols[0]):
                large = None
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        h = cols[0]
        if not len(h):
            continue
        cut = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])
        if cut:
            yield from close(*(c[:cut] for c in cols))
        rest = [c[cut:] for c in cols]
        if len(rest[0]) > TILE_ROWS:
            yield apart(*rest)
            rest, large = None, h[-1]
    if rest is not None and len(rest[0]):
        yield from close(*rest)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["n", "k"])
    packed = {c: rows[c].to_numpy(np.int64).tobytes() for c in ("k", "n", "comp", "at")}
    return pd.DataFrame({"h": [rows["h"].iloc[0]], "part": [rows["part"].iloc[0]], **{c: [v] for c, v in packed.items()}, "least": [rows["n"].iloc[0]], "most": [rows["n"].iloc[-1]], "sig": [b"".join(signature(b) for b in rows["bitmap"])]})


def _block_pairs(batches):
    """Pairs of blocks of one shingle come in, pairs of nodes that may link go out."""
    for batch in batches:
        for row in batch.to_pylist():
            x, y = ([np.frombuffer(row[c + side], np.int64) for c in ("k", "n", "comp", "at")] + [np.frombuffer(row["sig" + side], np.uint64).reshape(-1, SIGNATURE_WORDS)] for side in "xy")
            found = []
            for i in range(len(x[0])):
                n, at = x[1][i], x[3][i]
                # Blocks are sorted by size; a pair is met once, from its smaller node.
                low = i + 1 if row["partx"] == row["party"] else int(np.searchsorted(y[1], -(-PERCENT * n // 100)))
                j = np.arange(low, np.searchsorted(y[1], 100 * n // PERCENT, side="right"))
                both = PERCENT * (n + y[1][j])
                j = j[(y[2][j] != x[2][i]) & ((100 + PERCENT) * np.minimum(n - at, y[1][j] - y[3][j]) >= both)]
                if len(j):
                    differ = np.bitwise_count(y[4][j] ^ x[4][i]).sum(1).astype(np.int64)
                    j = j[(100 + PERCENT) * (n + y[1][j] - differ) >= 2 * PERCENT * (n + y[1][j])]
                    found.append(np.stack([np.minimum(x[0][i], y[0][j]), np.maximum(x[0][i], y[0][j])]))
            pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])


def _bitmaps_pass(a, b, na, nb) -> np.ndarray:
    return np.fromiter((linked(min(overlap_bound(x, y, int(p), int(q)), int(min(p, q))), int(p), int(q)) for x, y, p, q in zip(a, b, na, nb)), bool, len(a))


def _bitmap_filter(batches):
    for batch in batches:
        a, b, ma, mb, na, nb = batch.columns
        ok = _bitmaps_pass(ma.to_pylist(), mb.to_pylist(), np.asarray(na), np.asarray(nb))
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])


def _intersect(batches):
    for batch in slices(batches):
        a, b, sa, sb = batch.columns
        ok = []
        for x, y in zip(sa.to_pylist(), sb.to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["u", "v"])


def _arrays(batches):
    for batch in chunks(batches, 1):
        every, bounds = shingle_sets(batch.column(1))
        raw, at = every.tobytes(), (8 * bounds).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["k", "s"])


class _Sets:
    """Nodes (k, n, bitmap) and the texts behind them."""

    def __init__(self, nodes: DataFrame, texts: DataFrame):
        self.nodes, self.texts = nodes, texts

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that link, as edges (u, v)."""
        near = self.nodes.select("k", "n", "bitmap")
        with_a = pairs.join(near.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma")), "a")
        both = with_a.join(near.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb")), "b")
        sized = both.filter(PERCENT * F.greatest("na", "nb") <= 100 * F.least("na", "nb")).select("a", "b", "ma", "mb", "na", "nb")
        close = materialise(sized.mapInArrow(_bitmap_filter, "a long, b long"), "jaccard-close")
        involved = close.select(F.col("a").alias("k")).unionByName(close.select(F.col("b").alias("k"))).distinct()
        arrays = sized_join(self.texts.select("k", "text"), involved, "k", "left_semi").mapInArrow(_arrays, "k long, s binary")
        arrays = materialise(arrays, "jaccard-sets")
        pairs = close.join(arrays.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(arrays.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        edges = materialise(pairs.select("a", "b", "sa", "sb").mapInArrow(_intersect, "u long, v long"), "jaccard-links")
        discard(close, arrays)
        return edges


def _in_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    comps = connected_components(edges)
    return nodes.join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("component", "k")).drop("component")


def _mixed(large: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings (h, k, n, at, comp, c) of the shingles whose nodes are in several components; c counts a shingle's nodes. ``comps`` has the linked nodes."""
    here = large.select("h", "k", "n", "at").join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    split = here.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("h", "c")
    return here.join(split, "h")


def _hub_pairs(home: DataFrame, round_: int) -> DataFrame:
    """Pairs of a node (k, n, comp; h is its shingle) and a hub of its shingle that isn't linked to it yet."""
    hub = F.min_by(F.struct("k", "n", "comp"), F.xxhash64("k", F.lit(round_)))
    hubs = home.groupBy("h", F.pmod(F.xxhash64("k", F.lit(-1 - round_)), F.lit(HUBS)).alias("slot")).agg(hub.alias("hub"))
    able = (F.col("comp") != F.col("hub.comp")) & (PERCENT * F.greatest("n", "hub.n") <= 100 * F.least("n", "hub.n"))
    return home.join(hubs, "h").filter(able).select(F.least("k", "hub.k").alias("a"), F.greatest("k", "hub.k").alias("b")).distinct()


def _pairs_of_blocks(blocks: DataFrame) -> DataFrame:
    """Pairs (x, y) of blocks of one shingle whose sizes come near enough. Only the blocks' size ranges are paired up at
    first; the blocks then come to their pairs by (h, part), so no key holds more than one block's pairs."""
    ends = blocks.select("h", "part", "least", "most")
    x, y = (ends.select("h", *[F.col(c).alias(c + side) for c in ("part", "least", "most")]) for side in "xy")
    near = x.join(y, "h").filter(f"partx <= party and 100 * mostx >= {PERCENT} * leasty and 100 * mosty >= {PERCENT} * leastx").select("h", "partx", "party")
    for side in "xy":
        near = near.join(blocks.select("h", F.col("part").alias("part" + side), *[F.col(c).alias(c + side) for c in ("k", "n", "comp", "at", "sig")]), ["h", "part" + side])
    return near.select("h", *[c + side for side in "xy" for c in ("part", "k", "n", "comp", "at", "sig")])


def near_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(rows, keyed documents, name of their key). Rows: k, doc_id, n_shingles, node, comp."""
    spark = docs.sparkSession
    docs, key = keyed(docs)
    texts = docs.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialise(texts.mapInArrow(_profile, _PROFILE), "jaccard-profile")
    cells = profile.filter("kind = 1").groupBy("k").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << HEAVY_BITS, np.int32)
    for row in cells.toLocalIterator():  # at most 2**HEAVY_BITS cells
        table[row.k] = min(row.n, 2**31 - 1)
    heavy = spark.sparkContext.broadcast(table)
    rows = profile.filter("kind = 0").drop("kind")
    nodes = materialise(
        rows.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("k").alias("k"), F.first("bitmap").alias("bitmap"), F.first("low").alias("low")), "jaccard-nodes"
    )
    sets = _Sets(nodes, texts)

    # Leaders: the node of each min-hash whose own min-hashes are shared most.
    by_low = nodes.select("k", F.posexplode("low").alias("which", "low"))
    shared = by_low.groupBy("which", "low").agg(F.count("*").alias("many")).filter("many > 1")
    in_groups = by_low.join(shared, ["which", "low"])
    central = in_groups.groupBy("k").agg(F.sum("many").alias("central"))
    in_groups = materialise(in_groups.join(central, "k").select("which", "low", "k", "central"), "jaccard-groups")
    leaders = in_groups.groupBy("which", "low").agg(F.max_by("k", F.struct("central", F.xxhash64("k"))).alias("lead"))
    starred = in_groups.join(leaders, ["which", "low"]).filter("k <> lead").select(F.least("k", "lead").alias("a"), F.greatest("k", "lead").alias("b")).distinct()
    first = sets.verify(starred)
    known = materialise(_in_components(nodes.select("k", "n"), first), "jaccard-known")

    firsts = texts.select("k", "text").mapInArrow(_prefixes(heavy), "k long, first array<long>, hot array<boolean>")
    firsts = materialise(firsts.join(known, "k"), "jaccard-prefixes")
    posts = firsts.select("k", F.col("n").cast("int").alias("n"), "comp", F.posexplode(F.arrays_zip("first", "hot")).alias("at", "p")).select(F.col("p.first").alias("h"), "k", "n", "comp", "at", F.col("p.hot").alias("hot"))
    light = posts.filter("not hot").select("h", "k", "n", "comp", "at").repartition("h").sortWithinPartitions("h", "n")
    tiles = materialise(light.mapInArrow(_tiles, "kind int, h long, a long, b long, n int, comp long, at int"), "jaccard-tiles")
    large = posts.filter("hot").select("h", "k", "n", "at").unionByName(tiles.filter("kind = 1").select("h", F.col("a").alias("k"), "n", "at"))
    large = materialise(large, "jaccard-large")
    edges, comps, left = [first], known.filter("k <> comp").select("k", "comp"), []
    for round_ in range(HUB_ROUNDS):
        # Components only grow, so a shingle whose nodes are in one stays done: each round carries what the last one left.
        left.append(large)
        large = materialise(_mixed(large, comps), "jaccard-mixed")
        home = large.groupBy("k", "n", "comp").agg(F.max_by("h", F.struct("c", "h")).alias("h"))
        more = sets.verify(_hub_pairs(materialise(home, "jaccard-home"), round_))
        if not more.limit(1).count():
            break
        edges.append(more)
        comps = materialise(connected_components(reduce(DataFrame.unionByName, edges)).select(F.col("node").alias("k"), F.col("component").alias("comp")), "jaccard-linked")
    mixed = _mixed(large, comps).join(nodes.select("k", "bitmap"), "k").withColumn("part", F.pmod(F.xxhash64("k"), F.expr(f"cast((c + {BLOCK_NODES - 1}) div {BLOCK_NODES} as int)")).cast("int"))
    blocks = materialise(mixed.select("h", "part", "k", "n", "comp", "at", "bitmap").groupBy("h", "part").applyInPandas(_block, "h long, part int, k binary, n binary, comp binary, at binary, least long, most long, sig binary"), "jaccard-blocks")
    met = _pairs_of_blocks(blocks).mapInArrow(_block_pairs, "a long, b long")
    second = sets.verify(tiles.filter("kind = 0").select("a", "b").unionByName(met).distinct())
    final = _in_components(nodes.select("k", "n", "h1", "h2"), reduce(DataFrame.unionByName, [*edges, second]))
    final = final.select("n", "h1", "h2", F.col("k").alias("node"), "comp")
    out = materialise(
        rows.select("k", "doc_id", "n", "h1", "h2").join(final, ["n", "h1", "h2"], "left").select("k", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("node", "k").alias("node"), F.coalesce("comp", "k").alias("comp")),
        "jaccard-rows",
    )
    discard(profile, firsts, tiles, known, comps, large, *left, in_groups, blocks)
    return out, docs, key


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    rows, _, _ = near_components(docs)
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "comp").select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents with one of each component: that of the smallest doc_id (a null one counts as largest)."""
    columns = docs.columns
    rows, docs, key = near_components(docs)
    keep = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k"))["k"].alias("keep"))
    dropped = rows.join(keep, "comp").filter("k <> keep").select(F.col("k").alias(key))
    return sized_join(docs, dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
