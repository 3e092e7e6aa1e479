"""Language identification by nearest centroid.

A text is the TF-IDF vector of its byte 1- to 3-grams (letters of ASCII in lower case, other ASCII
characters as one space, all else as its UTF-8 bytes) hashed to ``DIMENSIONS`` places, with unit length.
Each language has ``CLUSTERS`` centroids found by spherical k-means; the language of the most similar
centroid wins and the cosine is the score. A text is rejected when it has no letter, or when its cosine
lies below a share of the least cosine that training texts of about its length have.

The classifier is fitted on at most about ``SAMPLE`` labelled rows, an equal quota for each language,
chosen by a hash of doc_id. Scoring is one pass without a shuffle over whole texts; the model that is
broadcast holds languages x clusters x dimensions floats.

Defined results: null text, or one without a letter, is ``und`` with score 0 and rejected; with nothing
to learn from, all texts are ``und`` with score 0 and none that has a letter is rejected; rows whose lang
or doc_id is null teach nothing; repeated rows each get their prediction; an empty table gives an empty
result; of equally similar languages the first in alphabetical order wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.llm.common import slices
from ledgerkit.llm.words import forget

DIMENSIONS = 8192
CLUSTERS = 4
#: Labelled rows that the classifier is fitted on.
SAMPLE = 6000
#: A text is rejected below this share of the least cosine among training texts of like length.
REJECT_SHARE = 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 22
_ROUNDS = 12


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    out = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, len(raw), _SLICE):
        a = np.frombuffer(raw[at : at + _SLICE + 2], np.uint8).astype(np.uint32)
        end = min(_SLICE, len(raw) - at)
        code = a
        for order in range(3):
            if order:
                code = code[:-1] * np.uint32(2654435761) + a[order:]
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519 + 2 * order)
            out += np.bincount((mixed >> np.uint32(19))[:end], minlength=DIMENSIONS)
    return out


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts -> rows of unit length."""
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _sparse(batches):
    for batch in slices(batches):
        langs, texts = batch.columns
        rows = [counts(t) for t in texts.to_pylist()]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays([langs, pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([r[a].astype("<f4").tobytes() for r, a in zip(rows, at)], pa.binary())], names=["lang", "places", "counts"])


def _bucket(total) -> np.ndarray:
    return np.clip(np.log2(np.maximum(total, 1)).astype(int), 0, 23)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: the first centroid is the mean, each next starts at the row least like those so far."""
    centres = [x.mean(0)]
    near = x @ centres[0] / max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(x)):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(_ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    """langs: one for each centroid row; floors: cosine below which a text of a length bucket is rejected."""

    def __init__(self, langs: list[str], centres: np.ndarray, idf: np.ndarray, floors: np.ndarray):
        self.langs, self.centres, self.idf, self.floors = langs, centres, idf, floors

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for t in texts:
            if not has_letter(t):
                out.append((UNKNOWN, 0.0, True))
            elif not self.langs:
                out.append((UNKNOWN, 0.0, False))
            else:
                tf = counts(t)
                cos = self.centres @ unit(tf, self.idf)
                best = int(cos.argmax())
                score = float(min(1.0, max(0.0, cos[best])))
                out.append((self.langs[best], score, score < self.floors[int(_bucket(tf.sum()))]))
        return out


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learn from text and lang of rows that aren't held out."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    none = Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(24))
    if not sizes:
        return none
    quota = max(1, sample // len(sizes))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, quota / n)))])[F.col("lang")]
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    got: dict[str, list] = {}
    for r in drawn.select("lang", "text").mapInArrow(_sparse, "lang string, places binary, counts binary").limit(2 * sample).toLocalIterator():
        got.setdefault(r.lang, []).append((np.frombuffer(r.places, "<u2"), np.frombuffer(r.counts, "<f4")))
    if not got:
        return none
    total = sum(map(len, got.values()))
    df = sum(np.bincount(p, minlength=DIMENSIONS) for v in got.values() for p, _ in v)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def dense(v):
        out = np.zeros((len(v), DIMENSIONS), np.float32)
        for row, (p, c) in zip(out, v):
            row[p] = c
        return out

    def units(v):
        """A few rows at a time, as what the driver holds besides the result counts too."""
        out = np.empty((len(v), DIMENSIONS), np.float32)
        for at in range(0, len(v), 256):
            out[at : at + 256] = unit(dense(v[at : at + 256]), idf)
        return out

    langs, centres = [], []
    for lang in sorted(got):
        # Bytes order the rows, so that the fit doesn't depend on the order in which tasks end.
        got[lang].sort(key=lambda pc: (len(pc[0]), pc[0].tobytes(), pc[1].tobytes()))
        c = cluster(units(got[lang]), clusters)
        langs += [lang] * len(c)
        centres.append(c.astype(np.float32))
    centres = np.concatenate(centres)
    least = np.full(24, np.inf)
    for lang in sorted(got):
        for at in range(0, len(got[lang]), 256):
            tf = dense(got[lang][at : at + 256])
            np.minimum.at(least, _bucket(tf.sum(1)), (unit(tf, idf) @ centres.T).max(1))
    # Longer texts are more like their centroid; a bucket never asks for more than the shortest longer one.
    floors = REJECT_SHARE * np.minimum.accumulate(np.where(np.isinf(least), 1.0, least)[::-1])[::-1]
    floors[np.isinf(least)] = np.minimum(floors[np.isinf(least)], REJECT_SHARE * np.nanmin(np.where(np.isinf(least), np.nan, least)))
    return Model(langs, centres, idf, floors)


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct of lang_pred, score, rejected."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for s in batches:
            yield pd.DataFrame(shared.value.predict([t if isinstance(t, str) else None for t in s]), columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    predict = predictor(docs.sparkSession, model or fit(docs))
    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    predict = predictor(docs.sparkSession, model or fit(docs))
    return docs.filter(~predict("text")["rejected"])
