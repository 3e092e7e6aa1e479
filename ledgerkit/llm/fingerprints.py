"""Document fingerprints: bottom-k sketches of word-shingle hashes, by DataFrame functions alone.

A word is a run of characters other than ASCII white space, in lower case; a shingle is five words in a row (all
words of a text that has fewer). The sketch of a text is the ``k`` smallest of its distinct shingle hashes, sorted.
Sketches of parts merge into the sketch of the whole, and two of them estimate resemblance (Jaccard), containment
and the number of distinct shingles; up to ``k`` shingles all figures are exact.

Scale: the hashes of a text are arrays inside one row, so nothing is exploded. The report meets each document with
the next one in ranges of the document order: their bounds come from approximate quantiles, the row at a bound is
copied to the range before, and the whole texts are shuffled once. ``merged`` cuts every group to its k smallest
hashes before the shuffle, so a group that holds a third of all rows sends k rows from each task.

Defined results: null text equals empty text; a wordless text has an empty sketch, which is like another empty one
(1) and unlike any other (0); a null ``doc_id`` comes last, rows of one id follow by text, descending; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.llm.common import WS_PATTERN, materialise

#: Hashes of a sketch: resemblance has a standard error of at most 0.5 / sqrt(256), 0.031.
SKETCH = 256
#: Words of a shingle.
WORDS = 5
#: Rows and bytes of text that a range of documents aims at, and the most ranges whose bounds the driver holds.
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 4_000, 8 << 20, 1 << 16
_STEP = 256
_WS = " \t\n\x0b\x0c\r"


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def _no_hashes() -> Column:
    return F.array().cast("array<bigint>")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text, in order."""
    words = F.split(F.nullif(F.btrim(F.lower(text), F.lit(_WS)), F.lit("")), WS_PATTERN)

    def runs(h: Column) -> Column:
        wide = lambda: F.transform(F.slice(h, F.lit(1), F.size(h) - (WORDS - 1)), lambda x, i: F.xxhash64(x, *[h[i + j] for j in range(1, WORDS)]))
        return F.when(h.isNull(), _no_hashes()).when(F.size(h) >= WORDS, wide()).otherwise(F.array(F.aggregate(h, F.size(h).cast("long"), lambda a, x: F.xxhash64(a, x))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def smallest(hashes: Column, k: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = SKETCH) -> Column:
    return smallest(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of two parts together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of the first one's shingles that the second one holds; 1 where the first has none.

    Judged by the hashes up to the smaller bound of the two sketches; null where the first one has none of those.
    """
    bound = lambda s: F.when(F.size(s) >= k, s[k - 1]).otherwise((1 << 63) - 1)
    seen = _let(F.least(bound(a), bound(b)), lambda top: F.filter(a, lambda x: x <= top))
    return F.when(F.size(a) == 0, 1.0).otherwise(_let(seen, lambda s: F.when(F.size(s) > 0, F.size(F.array_intersect(s, b)) / F.size(s))))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles, exact below ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**64) / (a[k - 1].cast("double") + F.lit(2.0**63)))


def encode(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each, high byte first."""
    raw = F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))  # some settings of Spark wrap base64


def decode(fingerprint: Column) -> Column:
    """The sketch of a fingerprint's text."""
    return _let(F.hex(F.unbase64(fingerprint)), lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: (i % 16 == 0) & (i < F.length(s))), lambda i: F.conv(F.substring(s, i + 1, F.lit(16)), 16, -10).cast("long")))


def merged(rows: DataFrame, by: str, sketches: str, k: int = SKETCH) -> DataFrame:
    """One sketch for each value of ``by``: (by, sketch). Groups are cut to their k smallest hashes in each task first."""
    hashes = rows.select(by, F.explode_outer(sketches).alias("hash")).distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("hash")))
    return hashes.withColumn("place", place).filter(F.col("place") <= k).groupBy(by).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ord): ascending unique numbers in the order of descending ids."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count():
        return docs.withColumn("ord", F.bitwise_not(F.col("doc_id").cast("long")))
    ordered = docs.orderBy(F.desc_nulls_last("doc_id"), F.desc("text")).withColumn("ord", F.monotonically_increasing_id())
    return materialise(ordered, "fingerprint-order")


def _constants(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) of each row and the one after it, the first after the last."""
    spark, docs = docs.sparkSession, _ordered(docs)
    n, size, low = docs.agg(F.count("*"), F.sum(F.octet_length("text").cast("long")), F.min("ord")).first()
    wanted = max(n // RANGE_ROWS, (size or 0) // RANGE_BYTES, min(n // 2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = ranges or max(1, min(MOST_RANGES, wanted))
    cuts = docs.agg(F.percentile_approx("ord", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0] if n and ranges > 1 else []
    bounds = sorted({low, *(cuts or [])} - {None}) or [0]  # values of rows; each range begins with its bound
    every = _constants(bounds)
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("ord")))
    tier = below(_constants(bounds[::_STEP])) - 1
    docs = docs.withColumn("range", _let(tier, lambda t: t * _STEP + below(F.slice(every, t * _STEP + 1, F.lit(_STEP))) - 1))
    own = F.struct(F.col("range"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("copy"))
    at = F.explode(F.when(every[F.col("range")] == F.col("ord"), F.array(own, before)).otherwise(F.array(own))).alias("at")
    dealt = docs.select("doc_id", "text", "ord", at).select("doc_id", "text", "ord", "at.range", "at.copy").repartition("range")
    order = Window.partitionBy("range").orderBy("copy", "ord")
    met = dealt.withColumn("sketch", sketch(F.col("text"))).select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    return met.filter(~F.col("copy")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprint_report(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document and its edited text: the last third gives way to the beginning of the next document."""
    rows = with_next(docs, ranges).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode(a).alias("fingerprint"),
        encode(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"),
        resemblance(a, c).alias("near_next"),
        containment(a, b).alias("held_by_edited"),
        distinct_shingles(a).alias("shingles"),
    )
