"""Numbers, dates, money and private terms in free text: vectors by hand, redaction against regular expressions of Python."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerkit.functions import extract
from ledgerkit.operators import terms

D = datetime.date


def each(spark, cases, column):
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, text string").select("i", column.alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_stated_numbers(spark):
    cases = {"Earn 4X on $25,000, then 1.5%": [1.5, 4.0, 25000.0], "no fee, Twenty-five dollars or none": [0.0, 25.0], "v1.2.3 and 7": [1.2, 7.0], "12,34": [12.0, 34.0], "": [], None: None, "someone often": []}
    assert each(spark, cases, extract.stated_numbers(F.col("text"))) == list(cases.values())


def test_expiry(spark):
    captured = F.lit("2026-05-01").cast("date")
    cases = {"7 days left": D(2026, 5, 8), "1 DAY left, ends 12/31/26": D(2026, 5, 2), "Expires 11/30/26": D(2026, 11, 30), "by 1/2/2027 or 3/4/2028": D(2027, 1, 2), "2026-09-05": D(2026, 9, 5), "Sept. 5, 2026": D(2026, 9, 5), "JUNE 3 2026": D(2026, 6, 3), "ends 13/45/26": None, "soon": None, "": None, None: None}
    assert each(spark, cases, extract.expiry_date(F.col("text"), captured)) == list(cases.values())
    assert each(spark, ["7 days left", "5/6/26, 7 days left"], extract.expiry_date(F.col("text"), F.lit(None).cast("date"))) == [None, D(2026, 5, 6)]


def test_money_and_days(spark):
    cases = {"paid $1,234.56 and 12.34, 9.99, 100.00": [1234, 123456], "1.234.56 then 77.10": [7710], "": []}
    assert each(spark, cases, extract.money_in(F.col("text"))) == list(cases.values())
    cases = {"2026-02-28, 3/4/26 and Dec. 9": ["02-28", "03-04", "12-09"], "13/1 is none, may 31": ["05-31"], "": []}
    assert each(spark, cases, extract.days_in(F.col("text"))) == list(cases.values())


def test_alternation_takes_the_longest(spark):
    pattern = extract.alternation(["Ann", "Ann  Lee", "", "a.b"])
    assert each(spark, ["ann   LEE met Anna, Ann and a.b, axb"], F.regexp_replace("text", pattern, "#")) == ["# met Anna, # and #, axb"]
    assert extract.alternation(["", " "]) is None
    assert each(spark, ["annals"], F.regexp_replace("text", extract.alternation(["ann"], whole=False), "#")) == ["#als"]


def test_scrub(spark):
    got = each(spark, ["Welcome back, ALEX! Card ending in 1234; Alex Example, 56789 and 567890", "Al"], extract.scrub(F.col("text"), ["Alex Example", "Al B"], ["56789", ""]))
    assert got == ["Welcome back, [name]! Card ending in [ending]; [name], [ending] and 567890", "Al"]


PEOPLE = {"Alex Example": "Pat Sample", "A. Example": "P. Sample"}


def redacted(text):
    def digits(m):
        hexed = "".join(hashlib.sha256(("salt" + plus + m[0]).encode()).hexdigest() for plus in ("", "+"))
        return hexed.translate(str.maketrans("abcdef", "012345"))[: len(m[0])]

    def name(m):
        fake = {k.upper(): v for k, v in PEOPLE.items()}.get(" ".join(m[0].split()).upper(), "Fake")
        return fake.upper() if m[0] == m[0].upper() else fake

    text = re.sub(r"\b(?:alex\s+example|a\.\s+example|example|alex)\b", name, text, flags=re.I)
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "fake@example.com", text)
    text = re.sub(r"\d{6,}", digits, text)
    text = re.sub(r"(?<![\d$,.])(?:4321)(?!\d|\.\d)", "0000", text)
    return re.sub(r"\bending\s+(?:in\s+)?\d{4,5}\b", lambda m: re.sub(r"\d", "0", m[0]), text, flags=re.I)


@pytest.mark.parametrize("source", ["hand", "docs"])
def test_redaction(spark, source):
    texts = ["Dear ALEX  EXAMPLE and alex, write to a.b@c.org", "acct 123456789012 and 123456789012, 12345", "4321 $4321 4321.00 14321 4,321; ending in 98765 Ending 1234", "a. example", "", "no names", "alexander"]
    if source == "docs":
        texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = each(spark, texts, extract.redacted(F.col("text"), PEOPLE, "salt", ["4321"]))
    assert got == [redacted(t) for t in texts]
    if source == "hand":
        a, b = re.findall(r"\d{12}", got[1])
        assert a == b != "123456789012"


@pytest.mark.parametrize("digits, ok", [("021000021", True), ("021000022", False), ("990000000", False), ("12345678", False), ("", False), (None, False), ("abcdefghi", False)])
def test_aba(spark, digits, ok):
    assert bool(spark.range(1).select(extract.aba_ok(F.lit(digits).cast("string")).alias("x")).first().x) is ok


def test_term_scan_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    some = [plain(r.text) for r in rows]
    known = {" ".join(w[i : i + n]) for w in some[::7] for i, n in ((0, 1), (1, 2), (3, 5)) if len(w) > 9} | {"not there at all", "...", ""}
    frame = spark.createDataFrame([(t,) for t in known], "term string")
    want = set()
    for r, w in zip(rows, some):
        for t in known:
            k = t.split() if plain(t) else []
            at = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k] if k else []
            if at:
                want.add((r.doc_id, t, len(at), at[0]))
    assert want and {tuple(r) for r in terms.scan(docs, frame).collect()} == want
    assert terms.scan(docs, frame.filter("false")).count() == 0
    with pytest.raises(ValueError, match="words"):
        terms.scan(docs, spark.createDataFrame([(" ".join("abcdefghijklm"),)], "term string"))
