"""Bottom-k sketches: against xxhash in plain Python, and their figures against exact sets."""

import base64
import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerkit.llm import fingerprints as fp

_MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values, seed):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def shingles(text):
    words = [signed(xxhash.xxh64_intdigest(w.lower().encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return set()
    if len(words) < 5:
        h = len(words)
        for w in words:
            h = signed(chained([h, w], 42))
        return {h}
    return {signed(chained(words[i : i + 5], 42)) for i in range(len(words) - 4)}


def bottom(text, k=fp.SKETCH):
    return sorted(shingles(text))[:k]


def text_of(sketch):
    return base64.b64encode(b"".join(struct.pack(">q", x) for x in sketch)).decode()


def like(a, b, k=fp.SKETCH):
    u = sorted({*a, *b})[:k]
    return len([x for x in u if x in a and x in b]) / len(u) if u else 1.0


def wanted(rows):
    order = sorted(rows, key=lambda r: r.text or "", reverse=True)
    order.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    out = []
    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        a, b, c = bottom(text), bottom(edited), bottom(after)
        out.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frame", ["odd", "near", "docs"])
@pytest.mark.parametrize("ranges", [None, 5])
def test_report_by_brute_force(frame, ranges, request):
    docs = request.getfixturevalue(frame)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprint_report(docs, ranges).collect()]
    assert sorted(got, key=str) == wanted(docs.collect())


def test_many_ranges_have_every_row(spark):
    docs = spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("doc_id"), F.concat_ws(" ", *[F.col("id") % m for m in (7, 11, 13, 17, 19, 23, 29)]).alias("text"))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprint_report(docs, 900).collect()]
    assert sorted(got, key=str) == wanted(docs.collect())


def test_one_row_follows_itself(odd):
    (r,) = fp.fingerprint_report(odd.filter("doc_id = 1")).collect()
    assert r.near_next == 1.0 and r.fingerprint and r.shingles == len(shingles(odd.filter("doc_id = 1").first().text))


def test_empty(empty):
    assert fp.fingerprint_report(empty).count() == 0
    assert fp.merged(empty.select("source", fp.sketch(F.col("text")).alias("s")), "source", "s").count() == 0


def test_figures_against_exact_sets(spark):
    words = [f"w{i}" for i in range(6000)]
    whole, part, other = " ".join(words), " ".join(words[:3000]), " ".join(words[1500:4500])
    r = spark.createDataFrame([(whole, part, other)], "a string, b string, c string").select(*[fp.sketch(F.col(c)).alias(c) for c in "abc"])
    a, b, c = (F.col(x) for x in "abc")
    got = r.select(fp.resemblance(a, b).alias("ab"), fp.containment(b, a).alias("b_in_a"), fp.containment(a, b).alias("a_in_b"), fp.containment(b, c).alias("b_in_c"), fp.distinct_shingles(a).alias("n"), (fp.decode(fp.encode(a)) == a).alias("again"), fp.distinct_shingles(fp.merge(b, c)).alias("m")).first()
    assert abs(got.ab - 0.5) < 0.12 and got.b_in_a == 1.0 and abs(got.a_in_b - 0.5) < 0.12 and abs(got.b_in_c - 0.5) < 0.15
    assert abs(got.n - 5996) < 1200 and abs(got.m - 4500) < 900 and got.again


def test_merged_parts_are_the_whole(docs):
    rows = docs.select("source", "lang", fp.sketch(F.col("text"), 64).alias("s"))
    sets = {}
    for r in docs.collect():
        sets.setdefault(r.source, set()).update(shingles(r.text))
    assert {r.source: r.sketch for r in fp.merged(rows, "source", "s", 64).collect()} == {k: sorted(v)[:64] for k, v in sets.items()}
    twice = fp.merged(fp.merged(rows.withColumn("both", F.concat_ws("/", "source", "lang")), "both", "s", 64).withColumn("source", F.split("both", "/")[0]), "source", "sketch", 64)
    assert {r.source: r.sketch for r in twice.collect()} == {k: sorted(v)[:64] for k, v in sets.items()}


def test_nothing_and_something(odd):
    got = {r.doc_id: r for r in odd.select("doc_id", fp.sketch(F.col("text")).alias("s"), fp.resemblance(fp.sketch(F.col("text")), fp.sketch(F.lit(" "))).alias("like_none"), fp.containment(fp.sketch(F.col("text")), fp.sketch(F.lit("x"))).alias("held")).filter("doc_id < 8").collect()}
    assert got[4].s == got[5].s == got[6].s == [] and got[4].like_none == 1.0 and got[1].like_none == 0.0 and got[5].held == 1.0 and got[1].held == 0.0
    assert got[1].s == got[2].s
