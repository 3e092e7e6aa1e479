"""Token ids by the ``tokenizers`` library, with its results for single words kept.

Byte-level BPE splits a text into words before it merges. A single space (or line feed) between two characters that
aren't white space always begins a new word, and so does an ASCII sign after a letter, so a text may be cut there and the
ids of its pieces joined: the ids are those of the whole text. Pieces recur, so each worker keeps the library's answer
for pieces it has met, up to ``CACHE_MOST``; beyond that, pieces are encoded anew. Pieces are cut, looked up and
joined by numpy over the bytes of a column; the library sees only pieces that aren't kept.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from ledgerkit.llm.words import bytes_of, hash_spans, kept_table

TOKENIZER = "byte_bpe_50k.json"
#: Pieces kept by a worker (about 45 MB).
CACHE_MOST = 1_000_000
#: Bytes of text that are encoded at a time.
CHUNK = 1 << 18
_encoders: dict[str, "Encoder"] = kept_table({})
_SPACE, _SIGN, _LETTER = (np.zeros(256, bool) for _ in range(3))
_SPACE[[*range(9, 14), 32]] = True
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _white(b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Whether these bytes are a Unicode white space of two (b0, b1) or three bytes."""
    two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    en = (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
    return two | en | ((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)) | ((b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each non-empty text, at single white space between characters that aren't, and at a sign after a letter."""
    pad = np.zeros(len(data) + 6, np.uint8)
    pad[3:-3] = data
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut = _SPACE[data] & (pad[2:-4] > 32) & (pad[4:-2] > 32)
    cut[heads[1:] - 1] = False  # the last byte of a text has no successor
    before, second = pad[2:-4], pad[1:-5]
    latin = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)  # all of U+00C0 to U+00FF but two are letters
    cut |= _SIGN[data] & (_LETTER[before] | latin)
    cut[heads] = True
    at = np.flatnonzero(cut)
    p = at + 3
    odd = np.flatnonzero((pad[p + 1] >= 0xC2) | (pad[p - 1] >= 0x80))
    if len(odd):
        q = p[odd]
        white = _white(pad[q + 1], pad[q + 2], pad[q + 3]) | _white(pad[q - 2], pad[q - 1], pad[q - 1] * 0) | _white(pad[q - 3], pad[q - 2], pad[q - 1])
        white &= ~np.isin(at[odd], heads)
        at = np.delete(at, odd[white])
    return at


def ragged_places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def ragged(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return pool[ragged_places(starts, counts)]


class _Kept:
    """A hash table in arrays: from a piece's two keys to its ids in a pool."""

    def __init__(self, most: int):
        self.most, self.n, self.used = most, 0, 0
        self.bits = 12
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.key1, self.key2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def find(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """Row of each piece, or -1."""
        out = np.full(len(key1), -1, np.int32)
        slot = (key1 >> np.uint64(64 - self.bits)).astype(np.int64)
        which = np.arange(len(key1))
        while len(which):
            row = self.slots[slot]
            there = row >= 0
            row, which, slot = row[there], which[there], slot[there]
            same = (self.key1[row] == key1[which]) & (self.key2[row] == key2[which])
            out[which[same]] = row[same]
            which, slot = which[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _place(self, rows: np.ndarray):
        slot = (self.key1[rows] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]  # of several rows one gets the slot
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _grown(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(a):
            a = np.concatenate([a[:used], np.empty(max(1024, used // 4, len(more)) , a.dtype)])
        a[used : used + len(more)] = more
        return a

    def add(self, key1, key2, count, ids):
        room = max(0, self.most - self.n)
        key1, key2, count = key1[:room], key2[:room], count[:room]
        ids = ids[: int(count.sum())]
        start = self.used + np.cumsum(count) - count
        rows = np.arange(self.n, self.n + len(key1), dtype=np.int32)
        self.key1, self.key2 = self._grown(self.key1, self.n, key1), self._grown(self.key2, self.n, key2)
        self.start, self.count = self._grown(self.start, self.n, start), self._grown(self.count, self.n, count)
        if len(ids) and self.pool.dtype == np.uint16 and ids.max() >= 1 << 16:
            self.pool = self.pool.astype(np.uint32)
        self.pool = self._grown(self.pool, self.used, ids)
        self.n, self.used = self.n + len(rows), self.used + len(ids)
        if 2 * self.n > len(self.slots):
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            rows = np.arange(self.n, dtype=np.int32)
        self._place(rows)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        # A byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())])
        self.kept = _Kept(CACHE_MOST)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        got = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _encode_later(self, joined: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with white space, in one text: as they are words of their own there, the bytes that ids stand for say where each ends."""
        ids = np.asarray(self.library.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(lengths)
        last = np.searchsorted(ends, wanted)
        if last[-1] >= len(ends) or (ends[last] != wanted).any():
            return self._encode([joined[e - n : e] for e, n in zip(wanted.tolist(), lengths.tolist())])
        return ids, np.diff(last, prepend=-1)

    def _library(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, later: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has); the first ``later`` pieces begin with the white space that they were cut at."""
        got = []
        for at in range(0, later, 1000):
            some = slice(at, min(at + 1000, later))
            lengths = ends[some] - starts[some]
            got.append(self._encode_later(data[ragged_places(starts[some], lengths)].tobytes(), lengths))
        if later < len(starts):
            got.append(self._encode([data[a:b].tobytes() for a, b in zip(starts[later:].tolist(), ends[later:].tolist())]))
        ids, counts = zip(*got)
        return np.concatenate(ids), np.concatenate(counts)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids, one more at last); null counts as empty."""
        data, offsets = bytes_of(texts)
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.r_[starts[1:], len(data)]
        key1 = hash_spans(data, starts, ends, seed=2, fold=False)
        # Further to the hash, a piece is told by its length and first eight bytes.
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))[starts]
        length = (ends - starts).astype(np.uint64)
        eight = np.where(length < 8, eight & ((np.uint64(1) << (length % 8 * 8)) - np.uint64(1)), eight)
        with np.errstate(over="ignore"):
            key2 = eight ^ (length * np.uint64(0x9E3779B97F4A7C15))
        row = self.kept.find(key1, key2)
        lost = np.flatnonzero(row < 0)
        counts = np.zeros(len(starts), np.int64)
        held = np.flatnonzero(row >= 0)
        counts[held] = self.kept.count[row[held]]
        if not len(lost):
            ids = ragged(self.kept.pool, self.kept.start[row], counts)
        else:
            order = lost[np.lexsort((key2[lost], key1[lost]))]
            new = np.r_[True, (key1[order[1:]] != key1[order[:-1]]) | (key2[order[1:]] != key2[order[:-1]])]
            one, which = order[new], np.cumsum(new) - 1
            # A text's first piece may begin with white space of its own, or with more than one; the library has it alone.
            alone = ~_SPACE[data[starts[one]]] | np.isin(starts[one], offsets)
            turn = np.argsort(alone, kind="stable")
            one, which = one[turn], np.argsort(turn)[which]
            fresh, n = self._library(data, starts[one], ends[one], int(len(one) - alone.sum()))
            counts[order] = n[which]
            at = np.cumsum(counts) - counts
            ids = np.empty(int(counts.sum()), np.uint32)
            for where, pool, begin in ((held, self.kept.pool, self.kept.start[row[held]]), (order, fresh, (np.cumsum(n) - n)[which])):
                ids[ragged_places(at[where], counts[where])] = ragged(pool, begin, counts[where])
            if self.kept.n < self.kept.most:
                self.kept.add(key1[one], key2[one], n, fresh)
        bounds = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, offsets)]
        return ids.astype(np.uint32, copy=False), bounds

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, bounds = self.column(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def encoder(name: str = TOKENIZER) -> Encoder:
    """One for each worker process."""
    if name not in _encoders:
        _encoders[name] = Encoder(tokenizer_path(name))
    return _encoders[name]
