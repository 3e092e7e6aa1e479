"""Words of Arrow string columns as 64-bit hashes, by numpy over the column's bytes: no Python object per word.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Its hash is a polynomial over random
values of its bytes, taken from prefix sums, so that all words of a column cost a few passes over its bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time: the temporary arrays stay in the processor's cache.
WINDOW = 1 << 15
#: Bytes of text that ``chunks`` aims at; a longer text is a chunk of its own.
CHUNK = 1 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(4)
def _tables(seed: int, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a random value for each byte, powers of an odd base, powers of its inverse)."""
    r = np.random.default_rng(seed)
    value = r.integers(0, _MASK, 256, np.uint64, endpoint=True)
    if fold:
        value[65:91] = value[97:123]
    base = int(r.integers(0, 1 << 61)) * 8 + 5
    powers = np.ones((2, 2 * WINDOW + 1), np.uint64)
    powers[0, 1:], powers[1, 1:] = base, pow(base, -1, 1 << 64)
    powers = np.multiply.accumulate(powers, axis=1)
    return value, powers[0], powers[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, fold: bool = True) -> np.ndarray:
    """Hash of each non-empty span of bytes; spans ascend and don't overlap."""
    value, up, down = _tables(seed, fold)
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            first = int(starts[at])
            last = int(np.searchsorted(starts, first + WINDOW))
            end = int(ends[last - 1])
            if end - first > 2 * WINDOW:  # the last span is longer than a window: it is hashed on its own
                last -= 1
                end = int(ends[last - 1]) if last > at else first
                if last == at:
                    out[at] = _long(data[first : int(ends[at])], value, up)
                    at += 1
                    continue
            sums = np.empty(end - first + 1, np.uint64)
            sums[0] = 0
            np.cumsum(value[data[first:end]] * up[: end - first], out=sums[1:])
            s = starts[at:last] - first
            out[at:last] = (sums[ends[at:last] - first] - sums[s]) * down[s]
            at = last
        return mix(out + (ends - starts).astype(np.uint64))


def _long(data: np.ndarray, value: np.ndarray, up: np.ndarray) -> np.uint64:
    total, shift = 0, 1
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW]
        total += int((value[part] * up[: len(part)]).sum(dtype=np.uint64)) * shift
        shift = shift * int(up[WINDOW]) & _MASK
    return np.uint64(total & _MASK)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all strings of a string or binary array, offsets of each); null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if where else np.zeros(1, np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


@lru_cache(1)
def _trimmer():
    name = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside its executor's heap when its task is done."""
    pa.default_memory_pool().release_unused()
    if _trimmer():
        _trimmer()(0)


_tables_kept: list = []


def kept_table(table: dict) -> dict:
    """``table``, which a worker keeps from one task to the next; tasks that don't ask for it empty it."""
    _tables_kept.append(table)
    return table


def forget() -> None:
    """Drop what tasks of another stage have kept."""
    for table in _tables_kept:
        table.clear()


def chunks(batches, text: int, size: int = CHUNK, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Record batches in slices whose column ``text`` has about ``size`` bytes. ``keep``: the task uses what earlier ones have kept."""
    if not keep:
        forget()
    for batch in batches:
        column = batch.column(text)
        if not len(column):
            continue
        _, offsets = bytes_of(column)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        give_back()


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of the texts that ``offsets`` bound."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_WS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = np.zeros(len(data) + 1, bool)
    stops[1:-1] = inside[:-1] & ~inside[1:]
    stops[-1] = inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]  # one text ends in a word and the next begins with one
    begins[cut] = stops[cut] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all strings, for each string the place of its first word, and the number of words at last)."""
    data, offsets = bytes_of(column)
    starts, ends = spans(data, offsets)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def line_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words; for each line with a word: bounds of its words, one more at last; its string; its number there from 0).

    Lines end at line feeds; lines without a word are counted but not given.
    """
    data, offsets = bytes_of(column)
    starts, ends = spans(data, offsets)
    feeds = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(feeds, offsets)) + 1  # of each string
    first = np.r_[0, np.cumsum(lines)].astype(np.int64)
    heads = np.empty(first[-1], np.int64)
    rest = np.ones(first[-1], bool)
    rest[first[:-1]] = False
    heads[first[:-1]], heads[rest] = offsets[:-1], feeds + 1
    bounds = np.r_[np.searchsorted(starts, heads), len(starts)]
    full = np.flatnonzero(np.diff(bounds))
    string = np.repeat(np.arange(len(lines)), lines)[full]
    return hash_spans(data, starts, ends), np.r_[bounds[full], len(starts)], string, full - first[string]


def distinct(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h, group) without repeats, sorted by group and hash; groups are small integers in ascending order."""
    if not len(h):
        return h, group
    # The group and the hash's upper bits sort together as one number; where the rest matters, both are sorted by.
    high = h >> np.uint64(24) | (group - group[0]).astype(np.uint64) << np.uint64(40)
    order = np.argsort(high)
    a, g, high = h[order], group[order], high[order]
    if int(group[-1] - group[0]) >= 1 << 24 or ((high[1:] == high[:-1]) & (a[1:] != a[:-1])).any():
        order = np.lexsort((h, group))
        a, g = h[order], group[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (g[1:] != g[:-1])]
    return a[keep], g[keep]
