"""Fill-in-the-middle: against regular expressions in plain Python, and exact round trips."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerkit.llm import fill_middle as fm
from ledgerkit.llm.words import bytes_of


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    return units, h, *arranged(units, h)


def arranged(units, h):
    text, n = "".join(units), len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=30), st.sampled_from(["<P>", "a<S>b", "<", "<P", "P>", "<M", ">", "é<S>", "<<S>>", "ab cd", "日本x語y", "S><P"])), st.tuples(*[st.integers(0, 2**32 - 1)] * 4)), max_size=7))
def test_kernel(rows):
    data, offsets = bytes_of(pa.array([t for t, _ in rows], pa.string()))
    h = np.array([x for _, x in rows], np.int64).reshape(len(rows), 4).T
    found = fm.cut_texts(data, offsets, h)
    out, bounds = fm.arranged(data, offsets, found)
    raw, back = out.tobytes(), fm.rebuilt(out, bounds, found["form"])
    for i, (text, numbers) in enumerate(rows):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
        form, p, m, want = arranged(units, numbers)
        assert (found["n"][i], fm.FORMS[found["form"][i]]) == (len(units), form)
        assert form == "plain" or (found["prefix_chars"][i], found["middle_chars"][i]) == (p, m)
        assert raw[bounds[i] : bounds[i + 1]].decode() == want
        assert back[0].tobytes()[back[1][i] : back[1][i + 1]].decode() == (text or "")


@pytest.mark.parametrize("frame", ["odd", "near", "docs"])
def test_report_by_brute_force(frame, request):
    docs, want = request.getfixturevalue(frame), []
    for r in docs.collect():
        units, _, form, p, m, out = plainly(r.doc_id, r.text)
        want.append((r.doc_id, len(units), form, p, m, sha(out), sha(r.text or "")))
    assert sorted(map(tuple, fm.fill_middle_report(docs).collect()), key=str) == sorted(want, key=str)


def test_outputs_are_rebuilt(odd, docs):
    for frame in (odd, docs):
        rows = fm.transformed(frame)
        assert sorted(map(tuple, rows.select("doc_id", "output").collect()), key=str) == sorted(((r.doc_id, plainly(r.doc_id, r.text)[-1]) for r in frame.collect()), key=str)
        assert sorted(map(tuple, fm.restored(rows).collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=str)


def test_forms_are_met_as_often_as_stated(docs):
    n = {r.form: r["count"] for r in fm.fill_middle_report(docs).groupBy("form").count().collect()}
    assert set(n) == {"plain", "psm", "spm"} and n["psm"] > n["spm"] > 0 and n["plain"] < docs.count() / 4


def test_output_without_markers_is_refused():
    data, offsets = bytes_of(pa.array(["abc"]))
    with pytest.raises(ValueError, match="markers"):
        fm.rebuilt(data, offsets, np.array([fm.PSM]))


def test_empty(empty):
    assert fm.fill_middle_report(empty).count() == 0 and fm.restored(fm.transformed(empty)).count() == 0
