"""Language ID, decontamination and the pipeline."""

import zlib

import numpy as np
import pytest
import regex
from conftest import SCHEMA, row
from conftest_llm import SMALL
from test_dedup import near_classes, norm
from test_tokens import plain

import corpus_pipeline
from ledgerkit.llm import decontaminate, langid, packing
from ledgerkit.llm.shingles import words_of


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held if got[r.doc_id].lang_pred != "und"]) > 0.99
    assert all((got[r.doc_id].lang_pred == "und") == (not regex.search(r"\p{L}", r.text or "")) for r in rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_by_brute_force(docs):
    model = langid.fit(docs)
    for r in docs.limit(20).collect():
        text = (r.text or "").encode()
        text = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in text)
        raw = b" " + b" ".join(text.split()) + b" "
        tf = np.zeros(langid.DIMENSIONS)
        for order in (1, 2, 3):
            for i in range(len(raw) - order + 1):
                code = raw[i]
                for x in raw[i + 1 : i + order]:
                    code = (code * 2654435761 + x) % 2**32
                mixed = (code ^ code >> 15) * (2246822519 + 2 * (order - 1)) % 2**32
                tf[mixed >> 19] += 1
        assert (tf == langid.counts(r.text or "")).all()
        if regex.search(r"\p{L}", r.text or ""):
            x = np.log1p(tf) * model.idf
            cos = model.centres @ (x / np.linalg.norm(x))
            assert model.predict([r.text])[0][1] == pytest.approx(min(1, max(0, cos.max())), abs=1e-5)


def test_language_ignores_labels_and_held_out(docs):
    from pyspark.sql import functions as F

    a = langid.fit(docs)
    b = langid.fit(docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("t")))
    assert a.langs == b.langs and np.allclose(a.centres, b.centres)
    assert len(a.langs) > len(set(a.langs))  # several centroids per language


def test_language_odd(odd, empty, docs, spark):
    got = langid.identify(odd, langid.fit(docs)).collect()
    assert len(got) == odd.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {4, 5, 6, 7, 13, 16} and all(r.rejected and r.score == 0 for r in got if r.doc_id in und)
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    nothing = langid.identify(odd.withColumn("lang", odd["comp"].substr(9, 1)).filter("false").unionByName(odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars", "k", "row_key", "comp", "keep_id", "score", "`a.b`"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    far = "".join(chr(0x4E00 + i % 2000) for i in range(3000))
    assert langid.fit(docs).predict([far])[0][2]
    assert langid.keep_identified(odd, langid.fit(docs)).columns == odd.columns


def windows(index, text):
    w = words_of(text)
    return [w[at : at + 2 * index.stride] for at in range(0, max(1, len(w)), index.stride)] if w else []


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_leaks(docs, items):
    """Without scores: every window against every item."""
    index = decontaminate.Index([(i, t) for i, t in items if t])
    parts = []
    for item_id, text in items:
        if words_of(text):
            q, a = decontaminate.question_and_answer(text)
            parts.append((item_id, grams(words_of(text)), grams(q), grams(a)))
    out = []
    for doc_id, text in docs:
        seen = [grams(w) for w in windows(index, text)]
        for item_id, whole, q, a in parts:
            share = lambda s, w: len(s & w) / len(s) if s else 0.0
            if any(share(whole, w) >= 0.8 or (share(q, w) >= 0.8 and share(a, w) >= 0.8) for w in seen):
                out.append((doc_id, item_id))
    return sorted(out, key=str)


def test_leaks_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.leaks(docs, items).collect()
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
    assert all(r.score >= 1 for r in got)
    in_parts = decontaminate.leaks(docs, items, part_bytes=2000).collect()
    # Another part's longest item gives other windows; items held whole are found either way.
    assert {(r.doc_id, r.item_id) for r in got if r.overlap == 1} <= {(r.doc_id, r.item_id) for r in in_parts}
    kept = decontaminate.drop_leaking(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_leaks_odd(odd, empty, spark):
    q, a = "what is the colour of the old house by the river that my uncle built", "the old house is green with a white door and two windows"
    rows = [(1, f"{q}\n{a}"), (2, None), (3, ""), (4, "one two"), (5, f"{q}\n{a}"), (None, "zzz yyy xxx www vvv uuu ttt")]
    items = spark.createDataFrame([(*r, "z") for r in rows], "item_id long, text string, doc_id string")
    more = spark.createDataFrame([row(30, f"{'noise ' * 3000}{q} so said {a}{' more' * 2000}"), row(31, a), row(32, "Zzz yyy\nxxx www vvv uuu ttt"), row(33, q.upper() + " " + a.upper())], SCHEMA)
    got = decontaminate.leaks(odd.unionByName(more), items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(8, 4), (8, 4), (8, 4), (9, 4), (30, 1), (30, 5), (32, 0), (33, 1), (33, 5)]
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.drop_leaking(empty, items).count() == 0
    none = items.filter("false")
    assert decontaminate.leaks(odd, none).count() == 0 and decontaminate.drop_leaking(odd, none).count() == odd.count()


def check_pipeline(docs, items, spark, sf_dir):
    """The stages' rows from plain Python."""
    rows = docs.collect()
    model = langid.fit(docs)
    rows = [r for r in rows if not model.predict([r.text])[0][2]]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    rows = list(first.values())
    rows = [r for r, (d, _, c) in zip(rows, near_classes(rows)) if d == c]
    leaking = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in items.collect()])}
    want = []
    for r in rows:
        if r.doc_id not in leaking:
            ids = plain(r.text, 2)
            want += [(r.doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) <= sum(w[3] for w in want) / 1024 * 1.01 + 1


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_pipeline(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    check_pipeline(docs, items, spark, sf_dir)


def test_pipeline_stages_take_odd_rows(spark, odd, empty):
    for frame in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SMALL)
            out.collect()
            assert name == "best_fit_packing" or out.columns == frame.columns
