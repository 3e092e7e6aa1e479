"""Fill-in-the-middle transformation: texts cut at token bounds and put into another order, by numpy over whole Arrow batches.

A token is a run of ASCII letters or any other single character. The bytes of all texts of a batch are looked up
in a table of classes; a byte begins a token unless it continues a character or both it and the byte before it are
letters of one text. Cumulative sums of these marks, set back at each text, number the tokens, and ``searchsorted``
finds the cuts of all rows together. Where to cut and which form to take follow from the SHA-256 of the row's id
alone, so a lost task is repeated alike. ``restored`` rebuilds the texts from outputs and forms.

Scale: no shuffle. Batches are cut to about a megabyte of text; a longer text is a batch of its own.

Defined results: null text is empty and plain; a null ``doc_id`` is hashed as an empty one; repeated rows are
transformed each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.words import bytes_of, chunks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
#: Hundredths of the rows that are transformed, and of those in suffix-prefix-middle order.
TRANSFORMED, SUFFIX_FIRST = 90, 20
_OTHER, _LETTER, _INNER = range(3)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[0x80:0xC0] = _INNER  # bytes that continue a character
_ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def cut_texts(data: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """For each text, bounded by ``offsets``, with its four hash numbers: n, form, the two cuts (byte places), prefix_chars, middle_chars."""
    kind = _CLASS[data]
    char = kind != _INNER
    begins = char.copy()
    letter = kind == _LETTER
    begins[1:] &= ~(letter[1:] & letter[:-1])
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[heads] = True
    wide = np.int32 if len(data) < 1 << 31 else np.int64
    tokens, chars = np.cumsum(begins, dtype=wide), np.cumsum(char, dtype=wide)
    upto = lambda sums, at: np.where(at > 0, sums[np.maximum(at, 1) - 1] if len(sums) else 0, 0).astype(np.int64)
    base = upto(tokens, offsets)
    n = np.diff(base)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    units = np.stack([np.minimum(a, b), np.maximum(a, b)])
    cuts = np.minimum(np.searchsorted(tokens, (base[:-1] + units + 1).astype(wide)), offsets[1:])
    plain = (n == 0) | (h[2] % 100 >= TRANSFORMED)
    plain[markers(data, offsets)[1]] = True
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < SUFFIX_FIRST, SPM, PSM))
    first, second = upto(chars, cuts[0]), upto(chars, cuts[1])
    return {"n": n, "form": form, "cuts": cuts, "prefix_chars": first - upto(chars, offsets[:-1]), "middle_chars": second - first}


def markers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all markers that lie within one text, their texts)."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = data[1:-1]
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & ((inner == PREFIX[1]) | (inner == SUFFIX[1]) | (inner == MIDDLE[1])))
    text = np.searchsorted(offsets, at, side="right") - 1
    whole = at + 3 <= offsets[text + 1]
    return at[whole], text[whole]


def _joined(pieces: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of rows of pieces."""
    sizes = np.array([sum(map(len, row)) for row in pieces], np.int64)
    return np.frombuffer(b"".join(x for row in pieces for x in row), np.uint8), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def arranged(data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs."""
    view, rows = memoryview(np.ascontiguousarray(data)), []
    for form, start, one, two, end in zip(found["form"].tolist(), offsets[:-1].tolist(), *found["cuts"].tolist(), offsets[1:].tolist(), strict=True):
        prefix, middle, suffix = view[start:one], view[one:two], view[two:end]
        rows.append([view[start:end]] if form == PLAIN else [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle] if form == PSM else [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return _joined(rows)


def rebuilt(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, from outputs and forms alone. Outputs that aren't plain hold each marker once."""
    at, text = markers(data, offsets)
    moved = np.flatnonzero(form != PLAIN)
    at = at[form[text] != PLAIN]
    if len(at) != 3 * len(moved):
        raise ValueError("an output doesn't hold the three markers of its form")
    places = np.zeros((len(form), 3), np.int64)
    places[moved] = at.reshape(-1, 3)
    view, rows = memoryview(np.ascontiguousarray(data)), []
    for kind, start, end, (p, q, r) in zip(form.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), places.tolist(), strict=True):
        one, two, three = view[p + 3 : q], view[q + 3 : r], view[r + 3 : end]
        rows.append([view[start:end]] if kind == PLAIN else [one, three, two] if kind == PSM else [two, three, one])
    return _joined(rows)


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    view, at = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _kernel(finish):
    """A map over batches of (doc_id, text, h1 to h4): ``finish(output bytes, offsets, forms)`` gives further columns."""

    def run(batches):
        for batch in chunks(batches, 1):
            data, offsets = bytes_of(batch.column(1))
            h = np.stack([batch.column(i).to_numpy() for i in range(2, 6)])
            found = cut_texts(data, offsets, h)
            out, bounds = arranged(data, offsets, found)
            plain = found["form"] == PLAIN
            columns = {"doc_id": batch.column(0), "n": pa.array(found["n"]), "form": pa.array(FORMS[found["form"]].tolist(), pa.string())}
            columns |= {c: pa.array(found[c], mask=plain) for c in ("prefix_chars", "middle_chars")}
            yield pa.RecordBatch.from_pydict(columns | finish(out, bounds, found["form"]))

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h1 to h4): the first four groups of eight digits of the hash of the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", *[number(i).alias(f"h{i + 1}") for i in range(4)])


def transformed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row."""
    return _numbered(docs).mapInArrow(_kernel(lambda out, bounds, form: {"output": _strings(out, bounds)}), f"{_ROWS}, output string")


def restored(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """(doc_id, text): the texts rebuilt from outputs and forms."""

    def run(batches):
        for batch in chunks(batches, 1):
            kinds = np.array([list(FORMS).index(x) for x in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": _strings(*rebuilt(*bytes_of(batch.column(1)), kinds))})

    return rows.select("doc_id", output, form).mapInArrow(run, "doc_id long, text string")


def fill_middle_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): each output is made, read back and rebuilt."""

    def digests(out, bounds, form):
        return {"output_sha256": _digests(out, bounds), "restored_sha256": _digests(*rebuilt(out, bounds, form))}

    return _numbered(docs).mapInArrow(_kernel(digests), f"{_ROWS}, output_sha256 string, restored_sha256 string")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
h AS (
  SELECT doc_id, text, units, len(units) AS n,
         CAST('0x' || digest[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || digest[9:16] AS BIGINT) % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM h)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
