"""Adaptive context-mixing range coder for token ids.

A segment holds whole documents. Its ids are cut into blocks of ``BLOCK`` ids that are modelled and coded
independently, each from a fresh state and with its own CRC-32, so a damaged block spoils no other.

Model of a block. Three predictors give the next id a probability each, and the coder codes the id with
their mixture ``P = l2 P2 + (1 - l2) l1 P1 + (1 - l2) (1 - l1) P0``:

* order 2, P2: the id that last followed the same two ids; order 1, P1: the one that last followed the same id.
  Each has a state: new, or how often in a row it was right. The weights l2 and l1 are adaptive probabilities of
  being right, kept apart by that state.
* order 0, P0: the segment's shares of ids, which stand in its head with a checksum. Ids are ranked by them.

The mixture has running sums in closed form (those of order 0, plus a weight on either side of a guess), so
an id costs one coding step and no search over ids. Its sums are whole numbers below 2**30.

Coder. The range variant of asymmetric numeral systems: a state of 63 bits and words of 32, coded from a block's last
id to its first and read the other way, so that reading takes no division. Blocks are coded in step with each
other: one numpy operation codes one symbol in every block of the segment.

Layout (little-endian): magic, version, block length, documents, ids, blocks, bytes and CRC-32 of the id table; for each
document id, whether it is null, and its number of ids; the id table (compressed: number of ids, ids by rank, their
shares); for each block its number of ids, words and CRC-32; then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION, BLOCK = b"LKAC", 3, 2048
_HEAD = struct.Struct("<4sBIQQIII")
_U = np.uint64
_ANY = 1 << 16
MOST_IDS = _ANY - 1
#: Contexts of a predictor in a block: small enough that the tables of a segment stay in the processor's cache.
_BITS = 8
#: States of a context: 0 new, 1 wrong, then right once, twice, ... in a row.
_STATE_BITS = 3
_LAST = (1 << _STATE_BITS) - 1
#: Weights are in 4096ths; they move by a 32nd of the error. First weights of orders 1 and 2 by state.
_UNIT_BITS, _RATE = 12, 5
_FIRST = np.array([[150, 220, 1150, 2400, 2900, 3000, 3400, 3950], [150, 120, 1000, 2700, 3300, 3400, 3600, 4000]], np.int32)
#: Sum of the shares of ids, and of the mixture's frequencies: weights x shares.
_SHARE_BITS = 18
_TOTAL_BITS = _UNIT_BITS + _SHARE_BITS
#: A coder's state lies from here to 2**32 times as much.
_LEAST, _WORD = _U(1 << 31), _U(32)


class _Table:
    """The segment's order-0 figures, by rank."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.ids, self.shares = ids.astype(np.uint16), shares.astype(np.int32)
        self.before = (np.cumsum(shares) - shares).astype(np.int32)
        self.rank_at = np.repeat(np.arange(len(ids), dtype=np.uint16), shares)

    @classmethod
    def fitted(cls, ids: np.ndarray) -> "_Table":
        counts = np.bincount(ids)
        there = np.flatnonzero(counts)
        there = there[np.argsort(-counts[there], kind="stable")]
        shares = 1 + ((1 << _SHARE_BITS) - len(there)) * counts[there] // len(ids)
        shares[0] += (1 << _SHARE_BITS) - shares.sum()
        return cls(there, shares)

    def pack(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + self.ids.astype("<u2").tobytes() + self.shares.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> "_Table":
        raw = zlib.decompress(data)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, "<u2", n, 4), np.frombuffer(raw, "<u4", n, 4 + 2 * n).astype(np.int64))


class _Model:
    """State of all blocks of a segment. Arrays of two rows are those of orders 1 and 2; guesses are ranks."""

    def __init__(self, lanes: int, table: _Table):
        self.table = table
        row = np.arange(2 * lanes).reshape(2, lanes)
        self.base, self.row = row << _BITS, row << _STATE_BITS
        self.entries = np.zeros(2 * lanes << _BITS, np.uint16 if len(table.ids) <= 1 << 16 - _STATE_BITS else np.uint32)  # a context's guess and its state
        self.weights = np.repeat(_FIRST, lanes, axis=0).reshape(-1)
        self.hashed, self.mixed = np.zeros((2, lanes), np.uint32), np.zeros(lanes, np.uint32)

    def predict(self, k: int):
        """For the first k blocks: guesses; weight of order 0; those of orders 1 and 2 in the mixture's frequencies."""
        self.at = self.base[:, :k] + (self.hashed[:, :k] >> np.uint32(32 - _BITS))
        entry = self.entries.take(self.at, mode="clip").astype(np.int32)
        self.state, self.guess = entry & _LAST, entry >> _STATE_BITS
        self.which = self.row[:, :k] + self.state
        self.weight = self.weights.take(self.which, mode="clip")
        m = self.weight.copy()
        rest = (1 << _UNIT_BITS) - m[1]
        m[0] = m[0] * rest >> _UNIT_BITS
        return self.guess, rest - m[0], m << _SHARE_BITS

    def order0(self, rank: np.ndarray, m0: np.ndarray):
        """(sum before a rank, its share) by order 0 in the mixture."""
        return self.table.before.take(rank, mode="clip") * m0, self.table.shares.take(rank, mode="clip") * m0

    def learn(self, k: int, rank: np.ndarray):
        right = self.guess == rank
        self.weights[self.which] = self.weight + ((right * np.int32(1 << _UNIT_BITS)) - self.weight >> _RATE)
        self.entries[self.at] = (rank << _STATE_BITS) + 1 + right * np.minimum(self.state, _LAST - 1)
        after = rank.astype(np.uint32) + np.uint32(1)
        hashed = self.hashed[:, :k]
        np.multiply(after, np.uint32(2654435769), out=hashed[0])
        np.bitwise_xor(hashed[0], self.mixed[:k], out=hashed[1])
        np.multiply(after, np.uint32(2246822519), out=self.mixed[:k])


def _lengths(n: int, block: int) -> np.ndarray:
    return np.minimum(block, n - np.arange(0, n, block)).astype(np.int64)


def _encode_blocks(ids: np.ndarray, block: int, table: _Table) -> tuple[np.ndarray, np.ndarray]:
    """(words of all blocks, number of words of each)."""
    lengths = _lengths(len(ids), block)
    lanes, steps = len(lengths), int(lengths[0])
    rank_of = np.zeros(_ANY, np.uint16)
    rank_of[table.ids] = np.arange(len(table.ids))
    padded = np.zeros(lanes * steps, np.uint16)
    padded[: len(ids)] = rank_of[ids]
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, table)
    starts, sizes = np.empty((2, steps, lanes), np.int32)
    for t in range(steps):
        k = lanes if t < lengths[-1] else lanes - 1
        now = grid[t, :k].astype(np.int32)
        guess, m0, m = model.predict(k)
        before, share = model.order0(now, m0)
        below, same = m * (guess < now), m * (guess == now)
        np.add(before + below[0], below[1], out=starts[t, :k])
        np.add(share + same[0], same[1], out=sizes[t, :k])
        model.learn(k, now)
    state, sent = np.full(lanes, _LEAST), []
    lane_type = np.uint16 if lanes <= 1 << 16 else np.uint32
    for t in reversed(range(steps)):
        k = lanes if t < lengths[-1] else lanes - 1
        x, size = state[:k], sizes[t, :k].astype(np.uint64)
        full = (x >> _U(63 - _TOTAL_BITS) >= size).nonzero()[0]
        now = x[full]
        sent.append((full.astype(lane_type), now.astype(np.uint32)))
        x[full] = now >> _WORD
        times = x // size
        x += times * (_U(1 << _TOTAL_BITS) - size) + starts[t, :k].astype(np.uint64)
    every = np.arange(lanes, dtype=lane_type)
    sent += [(every, state.astype(np.uint32)), (every, (state >> _WORD).astype(np.uint32))]
    which, words = (np.concatenate(x) for x in zip(*reversed(sent)))
    return words[np.argsort(which, kind="stable")], np.bincount(which, minlength=lanes)


def _decode_blocks(words: np.ndarray, counts: np.ndarray, lengths: np.ndarray, table: _Table) -> np.ndarray:
    lanes, steps = len(lengths), int(lengths[0])
    grid = np.zeros((steps, lanes), np.uint16)
    model = _Model(lanes, table)
    at = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    state = words.take(at, mode="clip").astype(np.uint64) << _WORD | words.take(at + 1, mode="clip")
    at += 2
    for t in range(steps):
        k = lanes if t < lengths[-1] else lanes - 1
        guess, m0, m = model.predict(k)
        x = state[:k]
        place = (x & _U((1 << _TOTAL_BITS) - 1)).astype(np.int32)
        start, size = model.order0(guess, m0)
        start += m[::-1] * (guess[::-1] < guess)
        size += m
        size[1] += m[0] * (guess[0] == guess[1])
        beyond = place >= start + size
        hit = (place >= start) ^ beyond
        # Without the guesses' weights that lie before it, the place is one of order 0.
        weights = m * beyond
        shift = weights[0] + weights[1]
        now = table.rank_at.take(((place - shift) / m0).astype(np.int64), mode="clip").astype(np.int32)
        begin, wide = model.order0(now, m0)
        begin += shift
        for i in (0, 1):
            np.copyto(now, guess[i], where=hit[i])
            np.copyto(begin, start[i], where=hit[i])
            np.copyto(wide, size[i], where=hit[i])
        x >>= _U(_TOTAL_BITS)
        x *= wide.astype(np.uint64)
        x += (place - begin).astype(np.uint64)
        few = (x < _LEAST).nonzero()[0]
        next_ = at[few]
        # Words of a damaged block may run out; what comes then fails the checksum.
        x[few] = x[few] << _WORD | words.take(next_, mode="clip")
        at[few] = next_ + 1
        grid[t, :k] = now
        model.learn(k, now)
    return table.ids[grid.T.reshape(-1)[: int(lengths.sum())]]


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Documents (their ids, how many token ids each has, all token ids below 2**16) as one segment."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= MOST_IDS):
        raise ValueError("ids must lie in 0..65534")
    table = _Table.fitted(ids) if len(ids) else None
    packed = table.pack() if len(ids) else b""
    head = [_HEAD.pack(MAGIC, VERSION, block, len(doc_ids), len(ids), -(-len(ids) // block), len(packed), zlib.crc32(packed))]
    head += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array(lengths, "<u8").tobytes(), packed]
    if not len(ids):
        return b"".join(head)
    words, counts = _encode_blocks(ids, block, table)
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[at : at + block].tobytes()) for at in range(0, len(raw), block)]
    return b"".join([*head, np.stack([_lengths(len(ids), block), counts, sums], axis=1).astype("<u4").tobytes(), words.astype("<u4").tobytes()])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their numbers of token ids, all token ids); a block that fails its checksum raises ValueError."""
    magic, version, block, docs, n, blocks, size, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    doc_ids = [None if z else int(k) for k, z in zip(keys.tolist(), nulls.tolist())]
    at += 17 * docs
    if not n:
        return doc_ids, lengths, np.zeros(0, "<u4")
    packed = data[at : at + size]
    if zlib.crc32(packed) != crc:
        raise ValueError("the id table is damaged")
    at += size
    figures = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    words = np.frombuffer(data, "<u4", -1, at + 12 * blocks).astype(np.uint32)
    ids = _decode_blocks(words, figures[:, 1], figures[:, 0], _Table.unpack(packed)).astype("<u4")
    for i, crc in enumerate(figures[:, 2]):
        if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return doc_ids, lengths, ids
