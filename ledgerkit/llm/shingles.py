"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerkit.llm import words as w

#: Words of a shingle.
WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8. bytes.split() knows just that white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, as those of a column."""
    return w.word_hashes(pa.array([b" ".join(words)], pa.binary()))[0]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words (of the whole if there are fewer), in order."""
    width = min(width, len(hashes))
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - width + 1].copy()
        for i in range(1, width):
            out = w.mix(out * _ODD + np.uint64(i)) + hashes[i : len(hashes) - width + 1 + i]
        return w.mix(out * _ODD + np.uint64(width))


def runs(hashes: np.ndarray, bounds: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``width`` words within a text, the text of each). A text of fewer words is one run, a wordless one has none."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out, group = np.zeros(0, np.uint64), text[:0]
    if len(hashes) >= width:
        whole = text[: len(hashes) - width + 1] == text[width - 1 :]
        out, group = rolling(hashes, width)[whole], text[: len(whole)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        more = np.concatenate([rolling(hashes[bounds[i] : bounds[i + 1]], width) for i in short.tolist()])
        out, group = np.r_[out, more], np.r_[group, short]
        order = np.argsort(group, kind="stable")
        out, group = out[order], group[order]
    return out, group


def shingle_sets(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's shingles, where each text's begin, one more at last)."""
    s, group = w.distinct(*runs(*w.word_hashes(texts), width))
    return s, np.r_[0, np.cumsum(np.bincount(group, minlength=len(texts)))].astype(np.int64)


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle; a wordless text has none."""
    return shingle_sets(pa.array([text], pa.string()), width)[0]
