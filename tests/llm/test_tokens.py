"""Token files, the range coder and packing: exact round trips and checks of every place."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerkit.llm import packing, token_files
from ledgerkit.llm.range_coder import decode_segment, encode_segment
from ledgerkit.llm.tokens import encoder

_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
_TOKENIZER.encode_special_tokens = True


def plain(text, end):
    return np.array([*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["a  b", " a", "a ", "it's he'll", "\u00a0x y\u3000z", "<|endoftext|> x", "a\n\nb c", "1234 56 é"])), max_size=6))
def test_ids_are_the_librarys(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder().ids(texts)] == [plain(t, 0)[:-1].tolist() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65534), st.integers(0, 5)), max_size=400), max_size=5), st.sampled_from([1, 7, 64, 2048]))
def test_range_coder_round_trip(parts, block):
    ids = np.array([x for p in parts for x in p], np.int64)
    keys = [None if i == 1 else i - 2 for i in range(len(parts))]
    got = decode_segment(encode_segment(keys, [len(p) for p in parts], ids, block))
    assert got[0] == keys and got[1].tolist() == [len(p) for p in parts] and got[2].tolist() == ids.tolist()


def test_range_coder_compresses_and_finds_damage():
    r = np.random.default_rng(2)
    words = [r.integers(0, 50_000, 6) for _ in range(40)]
    ids = np.concatenate([words[i] for i in r.integers(0, 40, 3000)])
    data = encode_segment([1], [len(ids)], ids)
    assert len(data) < len(ids)  # two bytes each before
    bad = bytearray(data)
    bad[-len(data) // 3] ^= 255
    with pytest.raises(ValueError, match="damaged"):
        decode_segment(bytes(bad))
    with pytest.raises(ValueError):
        encode_segment([1], [1], np.array([70_000]))


@pytest.mark.parametrize("frame", ["odd", "docs"])
def test_token_files(frame, request):
    docs = request.getfixturevalue(frame)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, at = [], 0
    for r in rows:
        ids = plain(r.text, 0)
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.round_trip(docs).collect()]
    if frame == "odd":  # rows without id have no order among each other but their text's
        assert sorted(got, key=str) == sorted(want, key=str)
    else:
        assert sorted(got) == want


def test_small_segments(docs, tmp_path):
    path = tmp_path.as_uri() + "/files"
    token_files.write_token_files(docs, path, segment=500)
    got = token_files.read_token_files(docs.sparkSession, path).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, token_files.round_trip(docs).collect()))


def test_empty(empty):
    assert token_files.round_trip(empty).count() == 0 and packing.pack(empty).count() == 0


@pytest.mark.parametrize("frame", ["odd", "docs"])
@pytest.mark.parametrize("capacity", [48, 1024])
def test_packing(frame, capacity, request):
    docs = request.getfixturevalue(frame)
    got = packing.pack(docs, capacity=capacity).collect()
    want = []
    for r in docs.collect():
        ids = plain(r.text, 2)
        for i, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            assert n == capacity or i == 0
            want.append((r.doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= capacity
    assert len(sequences) <= math.ceil(sum(w[3] for w in want) / capacity) * 1.03 + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 50)), max_size=20))
def test_plan_uses_up_the_histogram(pairs):
    h = np.zeros(65, np.int64)
    for length, n in pairs:
        h[length] += n
    used = np.zeros(65, np.int64)
    for lengths, n in packing.plan(h, 64):
        assert sum(lengths) <= 64 and n > 0
        np.add.at(used, list(lengths), n)
    assert (used == h).all()


def test_fit_is_non_negative_and_feasible():
    r = np.random.default_rng(4)
    h = r.integers(0, 100, 129)
    h[0] = 0
    pats = packing.patterns(h, 128)
    assert pats and all(sum(p) == 128 for p in pats) and any(len(p) > 2 for p in pats)
    n = packing.fit_counts(h, pats)
    used = np.zeros(129, np.int64)
    for p, x in zip(pats, n):
        np.add.at(used, list(p), x)
    assert (n >= 0).all() and (used <= h).all() and used.sum() > 0.5 * h.sum()
