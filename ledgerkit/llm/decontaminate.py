"""Benchmark decontamination: BM25 inverted index of test items, block-max weak-AND retrieval, exact verification.

Items are kept by length: an item of L words belongs to the tier whose stride is the least of 16, 32, 64, ... that is over
``5 L / 4``. Every training passage of a tier (a window of two strides, a new one each stride) queries the tier's inverted
index. So what an item meets depends on its own length alone, not on other items or on the part it comes in. The BM25
impact of a term on an item is divided by the least score that an item with enough verified overlap can have, so 1 is the
threshold for every item. The heavier of an item's question and answer is indexed too, as a further entry with a threshold
of its own. Entries are indexed in blocks, two for each of ``BLOCK_ITEMS`` items; a term's posting list holds its largest impact in each
block that has it. A passage whose terms' largest impacts together don't reach 1 is skipped. Else the terms are put in order of that
impact, and those that together can't reach 1 open no list: only blocks in the lists of the terms from the pivot on are bounded,
by all of the passage's terms, and only blocks whose bound reaches 1 are scored. What is
retrieved is verified: the share of the item's five-word shingles that the passage holds, for question
and answer together and for each of them. A document leaks an item when one passage holds 80 % of the item, or
one holds 80 % of the question and the same or another one 80 % of the answer.

The threshold loses nothing: overlap of 80 % leaves at most a fifth as many of an entry's words missing
as it has shingles, and the threshold is the entry's score without that many of its heaviest words.

Scale: documents are read once, without a shuffle. The index goes to all tasks, so the items are taken
in parts of ``PART_ITEMS`` items or ``PART_BYTES`` of text; a larger benchmark costs further passes over the documents. Counts of
items by term come from all items, in 2**20 cells, so that scores don't depend on the part either.

Defined results: null, empty or wordless texts and items leak nothing; items of under five words are one
shingle and aren't split; a question or answer of under five words is one run of words, wherever it stands; repeated items are matched one by one; null item ids are kept as null; repeated documents each
count; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import SLICE_ROWS, WS_PATTERN, ascii_lower
from ledgerkit.llm.shingles import WORDS, rolling, word_hashes, words_of
from ledgerkit.llm.tokens import ragged_places
from ledgerkit.llm.words import chunks, forget, give_back

OVERLAP_PERCENT = 80
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
_BLOCK = 2 * BLOCK_ITEMS
#: Text, and number, of the items that one pass over the documents looks for: the index stays below 100 MB.
PART_BYTES, PART_ITEMS = 4 << 20, 8000
#: Cells of the table of how many items have a word.
CELLS = 1 << 20


def _shingles(words: list[bytes]) -> np.ndarray:
    return np.unique(rolling(word_hashes(words), WORDS)) if words else np.empty(0, np.uint64)


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last line, or the last sentence of a single line; the question is what comes before."""
    body = text.strip()
    head, _, tail = body.rpartition("\n")
    if not head.strip():
        cut = body.rstrip(".").rfind(". ") + 1  # words keep their full stops, as they have them in a document
        head, tail = body[:cut], body[cut:]
    return words_of(head), words_of(tail)


class _Passage:
    """Shingles of a passage, by width, as they are asked for."""

    def __init__(self, words: list[bytes]):
        self.words, self.sets = words, {}

    def share(self, part: tuple[int, np.ndarray]) -> float:
        width, shingles = part
        if not len(shingles):
            return 0.0
        if width not in self.sets:
            self.sets[width] = np.unique(rolling(word_hashes(self.words), width))
        return float(np.isin(shingles, self.sets[width], assume_unique=True).mean())


def _part(words: list[bytes]) -> tuple[int, np.ndarray]:
    return min(WORDS, len(words)), _shingles(words)


def stride_of(words: int) -> int:
    """Words between the passages that an item of so many words is looked for in."""
    stride = 16
    while stride < words * 5 // 4 + 1:
        stride *= 2
    return stride


class _Tier:
    """Inverted index of the entries of items of one stride. An item: (id, words, whole, question, answer, parts), a part as by ``_part``."""

    def __init__(self, stride: int, items: list[tuple[int, tuple]], terms: dict[bytes, int], idfs: np.ndarray, mean: float):
        """items: (place, item); idfs: BM25's part for how many items have a term; mean: that of the items' lengths."""
        self.stride, self.items, self.terms = stride, dict(items), len(terms)

        def entry(words: list[bytes], shingles: int):
            """(least score, words, terms, impacts relative to the least score, heaviest terms of which one has to be there)."""
            ids, tf = np.unique(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)), return_counts=True)
            w = idfs[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            missing = (100 - OVERLAP_PERCENT) * shingles // 100
            order = np.argsort(-w)
            least = w.sum() - w[order[:missing]].sum()
            return least, len(words), ids, (w / max(least, 1e-9)).astype(np.float32) * np.float32(1 + 1e-5), tuple(ids[order[: missing + 1]].tolist())

        entries = []
        for i, (_, words, all_, q, a, parts) in items:
            entries.append((entry(words, len(all_[1])), i))
            if parts:  # both have to be found, so the heavier one retrieves
                entries.append((max((entry(words, len(s[1])) for words, s in zip(parts, (q, a))), key=lambda e: e[0]), i))
        # Entries of like length stand together, so that the maxima of a block are near each of them.
        entries.sort(key=lambda e: (e[0][1], e[1]))
        self.scored = [(i, *e[2:]) for e, i in entries]
        self.blocks = -(-len(entries) // _BLOCK)
        term = np.concatenate([e[1] for e in self.scored])
        key = term * self.blocks + np.repeat(np.arange(len(entries)) // _BLOCK, [len(e[1]) for e in self.scored])
        impact = np.concatenate([e[2] for e in self.scored])
        order = np.lexsort((-impact, key))
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        key, self.maxima = key[order][first], impact[order][first].astype(np.float64)
        self.block = key % self.blocks
        self.lists = np.searchsorted(key // self.blocks, np.arange(self.terms + 1))
        self.top = np.zeros(self.terms + 1)  # of terms that no entry has, and of words that aren't terms (-1), 0
        np.maximum.at(self.top, key // self.blocks, self.maxima)

    def candidates(self, ids: np.ndarray, place: np.ndarray, document: np.ndarray, lengths: np.ndarray) -> dict[int, list[tuple[int, list[int]]]]:
        """By document (passage, blocks whose bound reaches 1), for the terms (or -1) of all documents' words and their places."""
        known = np.flatnonzero(self.top[ids])
        n = self.terms
        first = np.r_[0, np.cumsum(lengths // self.stride + 1)]  # of each document's passages among all
        own = place[known] // self.stride
        cell = own + first[document[known]]
        # A word stands in the passage of its stride and in the one before.
        passage, term = np.r_[cell, cell[own > 0] - 1], np.r_[ids[known], ids[known[own > 0]]]
        pairs = np.unique(passage * n + term)
        passage, term = pairs // n, pairs % n
        if not len(pairs):
            return {}
        able = np.bincount(passage, self.top[term]) >= 1
        passage, term = passage[able[passage]], term[able[passage]]
        if not len(passage):
            return {}
        order = np.lexsort((self.top[term], passage))
        passage, term = passage[order], term[order]
        sums = np.cumsum(self.top[term])
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        before = np.repeat(sums[starts] - self.top[term][starts], np.diff(np.r_[starts, len(passage)]))
        opens = sums - before >= 1 - 1e-9
        counts = self.lists[term + 1] - self.lists[term]
        where = ragged_places(self.lists[term], counts)
        key = np.repeat(passage, counts) * self.blocks + self.block[where]
        listed, which = np.unique(key, return_inverse=True)
        bound = np.bincount(which, self.maxima[where])
        opened = np.zeros(len(listed), bool)
        opened[which[np.repeat(opens, counts)]] = True
        found: dict[int, list[int]] = {}
        for k in listed[opened & (bound >= 1)].tolist():
            found.setdefault(k // self.blocks, []).append(k % self.blocks)
        out: dict[int, list] = {}
        for p, d in zip(found, (np.searchsorted(first, list(found), side="right") - 1).tolist()):
            out.setdefault(d, []).append((p - int(first[d]), found[p]))
        return out

    def leaks(self, words: list[bytes], ids: np.ndarray, found: list[tuple[int, list[int]]]) -> dict[int, tuple[float, float, float, float]]:
        best: dict[int, list[float]] = {}
        present = np.zeros(self.terms, bool)
        for w, blocks in found:
            span = ids[w * self.stride : (w + 2) * self.stride]
            here, passage = span[span >= 0], None
            present[here] = True
            held_terms = set(here.tolist())
            for b in blocks:
                for i, terms, impact, heaviest in self.scored[b * _BLOCK : (b + 1) * _BLOCK]:
                    if held_terms.isdisjoint(heaviest):
                        continue
                    score = float(impact[present[terms]].sum())
                    if score < 1:
                        continue
                    if passage is None:
                        passage = _Passage(words[w * self.stride : (w + 2) * self.stride])
                    _, _, all_, q, a, _ = self.items[i]
                    held = score, passage.share(all_), passage.share(q), passage.share(a)
                    best[i] = [max(x) for x in zip(best[i], held)] if i in best else [*held]
            present[here] = False
        passages = None
        for i, held in best.items():
            enough = [100 * x >= OVERLAP_PERCENT for x in held]
            if self.items[i][5] and not enough[1] and enough[2] != enough[3]:
                # One part is held; the other one may stand anywhere in the document.
                other = 3 if enough[2] else 2
                if passages is None:
                    passages = [_Passage(words[at : at + 2 * self.stride]) for at in range(0, len(words), self.stride)]
                held[other] = max(p.share(self.items[i][other + 1]) for p in passages)
        return {i: tuple(x) for i, x in best.items() if 100 * x[1] >= OVERLAP_PERCENT or (100 * x[2] >= OVERLAP_PERCENT and 100 * x[3] >= OVERLAP_PERCENT)}


class Index:
    """``frequencies``: (items, their mean length, items by cell of a word) of the whole benchmark; those of ``items`` by default."""

    def __init__(self, items: list[tuple[int | None, str]], frequencies: tuple[int, float, dict[int, int]] | None = None):
        self.items = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                q, a = question_and_answer(text) if len(words) >= WORDS else ([], [])
                self.items.append((item_id, words, (WORDS, _shingles(words)), _part(q), _part(a), (q, a) if q and a else ()))
        self.items.sort(key=lambda x: (len(x[1]), x[0] is None, x[0] or 0, x[1]))
        if frequencies is None:
            cells: dict[int, int] = defaultdict(int)
            for x in self.items:
                for c in {cell_of(w) for w in x[1]}:
                    cells[c] += 1
            frequencies = len(self.items), sum(len(x[1]) for x in self.items) / max(1, len(self.items)), cells
        n, mean, cells = frequencies

        def idf(word: bytes) -> float:
            df = min(n, cells.get(cell_of(word), 1))
            return float(np.log(1 + (n - df + 0.5) / (df + 0.5)))

        by_stride: dict[int, list] = defaultdict(list)
        for i, x in enumerate(self.items):
            by_stride[stride_of(len(x[1]))].append((i, x))
        self.terms: dict[bytes, int] = {}
        for x in self.items:
            for w in x[1]:
                self.terms.setdefault(w, len(self.terms))
        idfs = np.array([idf(w) for w in self.terms])
        self.tiers = [_Tier(stride, some, self.terms, idfs, mean) for stride, some in sorted(by_stride.items())]
        self.stride = max([16, *by_stride])

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """Place of an item -> (BM25 score relative to its threshold, overlap of the item, question, answer): the best of all passages."""
        return self.leaks_of([text])[0]

    def leaks_of(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float, float]]]:
        """``leaks`` of each text; the passages of all are bounded together."""
        words, get = [words_of(t) for t in texts], self.terms.get
        out: list[dict] = [{} for _ in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        if not self.tiers or not lengths.sum():
            return out
        ids = np.fromiter((i for w in words for i in map(get, w, repeat(-1))), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        document = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(ids)) - (ends - lengths)[document]
        for tier in self.tiers:
            for d, found in tier.candidates(ids, place, document, lengths).items():
                out[d].update(tier.leaks(words[d], ids[ends[d] - lengths[d] : ends[d]], found))
        return out


def cell_of(word: bytes) -> int:
    """Cell of a word in the table of frequencies, as ``xxhash64`` gives it."""
    return xxhash.xxh64_intdigest(word, 42) & (CELLS - 1)


def frequencies(items: DataFrame) -> tuple[int, float, dict[int, int]]:
    """(items with words, their mean number of words, items by cell of a word)."""
    words = F.filter(F.split(ascii_lower(F.col("text")), WS_PATTERN), lambda w: w != "")
    rows = items.select(words.alias("words")).filter("size(words) > 0")
    n, mean = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    cells = F.explode(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(CELLS - 1)))))
    found = rows.select(cells.alias("cell")).groupBy("cell").count()
    return n, mean or 0.0, {r[0]: r[1] for r in found.toLocalIterator()}  # at most CELLS rows


def _parts(items: DataFrame, part_bytes: int) -> Iterator[Index]:
    """The items, part by part; the driver holds one part at a time."""
    part, size, counts = [], 0, frequencies(items)
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if r.text:
            part.append((r.item_id, r.text))
            size += len(r.text)
        if size >= part_bytes or len(part) >= PART_ITEMS:
            yield Index(part, counts)
            part, size = [], 0
    if part:
        yield Index(part, counts)


def leaks(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each document and item it leaks: doc_id, item_id, score, overlap, question_overlap, answer_overlap."""
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _parts(items, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            for batch in chunks(batches, 1):
                index, rows = shared.value, []
                ids, texts = (c.to_pylist() for c in batch.columns)
                for doc_id, held in zip(ids, index.leaks_of(texts)):
                    rows += [(doc_id, index.items[i][0], *v) for i, v in sorted(held.items())]
                columns = list(zip(*rows)) or [()] * 6
                types = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema))
    return out


def _clean_with(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for s in batches:
            texts = [t if isinstance(t, str) else None for t in s]
            clean = []
            for at in range(0, len(texts), SLICE_ROWS):
                clean += [not held for held in shared.value.leaks_of(texts[at : at + SLICE_ROWS])]
            yield pd.Series(clean, dtype=bool)
            give_back()

    return clean


def drop_leaking(docs: DataFrame, items: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    for index in _parts(items, part_bytes):
        docs = docs.filter(_clean_with(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return docs
