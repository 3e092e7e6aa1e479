"""URL filter: rules first, then the ratio of two character language models.

A rule names a host and a path prefix and fits that host and its subdomains; the longest fitting rule
decides. URLs that rules judge train two variable-order Markov models, one of accepted and one of
rejected URLs: the probability of a character given up to ``ORDER`` characters before it, where each
order is smoothed with the next lower one by Witten and Bell's method. A URL that no rule fits is judged
by ``(log P(url | accepted) - log P(url | rejected)) / characters``: it is allowed from the threshold on
that separates a held-back fifth of the judged URLs best.

Scale: one pass counts character runs, combined in each task before the shuffle, and one scores. With 32
character classes there are 2**20 runs of four, so the counts and the table of log ratios (4 MB) are
bounded whatever the input. All judged URLs are counted; nothing is sampled.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule, has score 0
and is allowed if 0 reaches the threshold; a null URL trains nothing; repeated rows are judged each; if
rules accept, or reject, no URL at all, every other URL is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
#: (rule, verdict): everything before the first slash is the host, the rest the start of the path.
RULES = (("com/en/", BLOCK), ("example.com/en/7", ALLOW), ("net/de/", ALLOW), ("example.net/de/8", BLOCK), ("org/es/", BLOCK))
#: Characters before the one that is predicted.
ORDER = 3
#: One URL of so many is held back from the models for calibration.
HELD_BACK = 5
_BITS, _CLASSES = 5, 32
_EDGE = 0
_CELLS = 1 << _BITS * (ORDER + 1)
#: Scores are calibrated on a histogram with steps of 1/50 between -10 and 10.
_STEPS, _MOST = 50, 500


def _classes() -> np.ndarray:
    """Class of a byte: 1-26 letters, 27 digits, 28 '/', 29 '.', 30 '-' and '_', 31 all else; 0 is the edge."""
    out = np.full(256, 31, np.int64)
    for i in range(26):
        out[[65 + i, 97 + i]] = 1 + i
    out[48:58], out[ord("/")], out[ord(".")] = 27, 28, 29
    out[[ord("-"), ord("_")]] = 30
    return out


_CLASS = _classes()


def runs(text: str | None) -> np.ndarray:
    """Code of each character, and of the end, with the ORDER characters before it."""
    if not text:
        return np.empty(0, np.int64)
    c = np.r_[[_EDGE] * ORDER, _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], _EDGE]
    code = np.zeros(len(c) - ORDER, np.int64)
    for i in range(ORDER + 1):
        code = code << _BITS | c[i : len(c) - ORDER + i]
    return code


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Counts of all runs -> log probability of each run's last character after the others."""
    p = np.full(1, 1 / _CLASSES)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, _CLASSES ** (order + 1)).sum(0).reshape(-1, _CLASSES)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        # The context without its first character; for order 0 the uniform distribution.
        lower = np.broadcast_to(p, n.shape) if order == 0 else np.tile(p, (_CLASSES, 1))
        p = np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p).reshape(-1)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url), F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def judged(rules=RULES, host: str = "host", path: str = "path") -> Column:
    """Struct of the longest rule that fits and its verdict, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith("/" + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _count(batches):
    """(accepted, held back, run, n), combined within a batch."""
    for batch in batches:
        parts = []
        for accepted, back, text in zip(*(c.to_pylist() for c in batch.columns)):
            parts.append(runs(text) | (accepted * 2 + back) << _BITS * (ORDER + 1))
        codes, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes >> _BITS * (ORDER + 1)), pa.array(codes & (_CELLS - 1)), pa.array(n.astype(np.int64))], names=["kind", "run", "n"])


def _score_with(shared):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            coded = [runs(t) for t in s]
            yield pd.Series([float(shared.value[c].mean()) if len(c) else 0.0 for c in coded], dtype=float)

    return score


def threshold(histogram: dict[tuple[int, bool], int]) -> float:
    """The step that maximises the mean of the two classes' recalls; of equal ones the nearest to 0."""
    accepted, rejected = np.zeros(2 * _MOST + 1), np.zeros(2 * _MOST + 1)
    for (step, is_accepted), n in histogram.items():
        (accepted if is_accepted else rejected)[step + _MOST] += n
    if not accepted.sum() or not rejected.sum():
        return 0.0
    kept = accepted[::-1].cumsum()[::-1] / accepted.sum()
    passed = rejected[::-1].cumsum()[::-1] / rejected.sum()
    gain = kept - passed
    best = np.flatnonzero(gain >= gain.max() - 1e-12) - _MOST
    return float(best[np.abs(best).argmin()]) / _STEPS


def filter_urls(pages: DataFrame, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per page: the ``keep`` columns, host, path, rule, verdict, score, threshold."""
    spark = pages.sparkSession
    host, path = host_and_path(url)
    rows = pages.select(*keep, F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__rule", judged(rules)).withColumn("__text", F.concat("host", "path"))
    known = rows.filter("__rule is not null").select((F.col("__rule.verdict") == ALLOW).cast("int").alias("accepted"), (F.pmod(F.xxhash64("__url"), F.lit(HELD_BACK)) == 0).cast("int").alias("back"), "__text")
    cells = known.mapInArrow(_count, "kind long, run long, n long").groupBy("kind", "run").agg(F.sum("n").alias("n"))
    counts = np.zeros((4, _CELLS))
    for r in cells.toLocalIterator():  # at most 4 * 2**20 cells
        counts[r.kind, r.run] = r.n
    if counts[:2].sum() and counts[2:].sum():
        # Kinds: rejected, rejected and held back, accepted, accepted and held back.
        fitted = [counts[i] if counts[i].sum() else counts[i + 1] for i in (0, 2)]
        ratio = (log_probabilities(fitted[1]) - log_probabilities(fitted[0])).astype(np.float32)
        score = _score_with(spark.sparkContext.broadcast(ratio))
        step = F.least(F.greatest(F.floor(score("__text") * _STEPS), F.lit(-_MOST)), F.lit(_MOST))
        seen = known.filter("back = 1").groupBy(step.alias("step"), (F.col("accepted") == 1).alias("accepted")).count().collect()  # at most 2 * 1001 rows
        least = threshold({(r["step"], r["accepted"]): r["count"] for r in seen})
        rows = rows.withColumn("score", score("__text"))
    else:
        least, rows = 0.0, rows.withColumn("score", F.lit(0.0))
    by_model = F.when(F.col("score") >= least, ALLOW).otherwise(BLOCK)
    return rows.select(*keep, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), by_model).alias("verdict"), "score", F.lit(least).alias("threshold"))
