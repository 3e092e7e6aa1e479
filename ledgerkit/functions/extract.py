"""Columns that read numbers, dates and money out of free text, and that take names and numbers out of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerkit.functions.text import document_text

# Number words, and how numbers, dates and money are written.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "twenty-five": 25, "thirty": 30, "fifty": 50,
}
ZERO_WORDS = ("no", "none", "zero")
_NUMBER = r"(?<![\d.])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
_DAYS_LEFT = r"(?i)\b(\d{1,3})\s+days?\s+left\b"
_DATE = r"(?i)\b(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"
_FORMATS = ("M/d/yyyy", "M/d/yy", "yyyy-MM-dd", "MMM d yyyy", "MMMM d yyyy")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONEY = r"(?<![\d.,])\$?((?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2})(?![\d.])"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_LONG_DIGITS = r"\d{6,}"
_ENDING = r"(?i)(\bending\s+(?:in\s+)?)\d{4,5}\b"
_ABA_PREFIXES = [*range(0, 13), *range(21, 33), *range(61, 73), 80]


def stated_numbers(text: Column) -> Column:
    """Distinct numbers that a text states: in digits, as words, and 0 for "no" or "none"."""
    plain = document_text(text)
    digits = F.transform(F.regexp_extract_all(plain, F.lit(_NUMBER), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    names = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, float(n))])
    tokens = F.regexp_extract_all(plain, F.lit(r"([a-z]+(?:-[a-z]+)?)"), 1)
    words = F.array_compact(F.transform(tokens, lambda w: F.when(w.isin(*ZERO_WORDS), 0.0).otherwise(F.try_element_at(names, w))))
    return F.array_sort(F.array_distinct(F.concat(digits, words)))


def expiry_date(text: Column, captured: Column) -> Column:
    """``N days left`` counted from the day of capture, else the first date in the text, in one of five forms. A day that doesn't exist is null."""
    left = F.regexp_extract(text, _DAYS_LEFT, 1).try_cast("int")
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, _DATE, 1), "[.,]", " "), r"\s+", " "))
    raw = F.initcap(F.regexp_replace(raw, r"(?i)^sept\b", "Sep"))
    # Each form is tried on texts of its shape only: a form of two-digit years would read the first two of four.
    year = F.length(F.regexp_extract(raw, r"/(\d+)$", 1))
    shape = [year == 4, year == 2, raw.rlike("^\\d{4}-"), raw.rlike("^[A-Z][a-z]{2} "), raw.rlike("^[A-Z][a-z]{3,} ")]
    dates = [F.when(ok, F.try_to_timestamp(raw, F.lit(form)).cast("date")) for ok, form in zip(shape, _FORMATS)]
    return F.coalesce(F.when(captured.isNotNull(), F.date_add(captured, left)), *dates)


def money_in(text: Column, least: int = 1000) -> Column:
    """Distinct amounts in cents that are printed with cents, at least ``least`` and not whole dollars."""
    cents = F.transform(F.regexp_extract_all(text, F.lit(_MONEY), 1), lambda x: F.regexp_replace(x, "[,.]", "").cast("long"))
    return F.array_sort(F.array_distinct(F.filter(cents, lambda c: (c >= least) & (c % 100 != 0))))


def days_in(text: Column) -> Column:
    """Distinct (month, day) pairs of ISO, US and named dates, as ``MM-dd``."""
    pair = lambda m, d: F.format_string("%02d-%02d", m.cast("int"), d.cast("int"))
    two = lambda pattern, a, b: F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), a).alias("a"), F.regexp_extract_all(text, F.lit(pattern), b).alias("b")), lambda x: x)
    iso = F.transform(two(r"\b\d{4}-(0[1-9]|1[0-2])-([0-2]\d|3[01])\b", 1, 2), lambda x: pair(x["a"], x["b"]))
    us = F.transform(two(r"\b(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])(?:/\d{2,4})?\b", 1, 2), lambda x: pair(x["a"], x["b"]))
    months = F.array(*map(F.lit, MONTHS))
    named = F.transform(two(rf"(?i)\b({'|'.join(MONTHS)})[a-z]*\.?\s+(0?[1-9]|[12]\d|3[01])\b", 1, 2), lambda x: pair(F.array_position(months, F.lower(x["a"])), x["b"]))
    return F.array_sort(F.array_distinct(F.concat(iso, us, named)))


def alternation(terms: Sequence[str], whole: bool = True) -> str | None:
    """One pattern for all terms, the longest first, inner space of any width; of whole words or anywhere. None without terms."""
    parts = sorted({" ".join(t.split()) for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    body = "|".join("\\s+".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in t.split()) for t in parts)
    return (rf"(?i)\b(?:{body})\b" if whole else f"(?i)(?:{body})") if parts else None


def scrub(text: Column, names: Sequence[str], endings: Sequence[str]) -> Column:
    """Names (whole words, first names of three letters or more too) and card endings by placeholders."""
    out = F.regexp_replace(text, _ENDING, "$1[ending]")
    if any(endings):
        out = F.regexp_replace(out, rf"\b(?:{'|'.join(sorted(e for e in endings if e))})\b", "[ending]")
    firsts = [n.split()[0] for n in names if n.split() and len(n.split()[0]) >= 3]
    pattern = alternation([*names, *firsts])
    return F.regexp_replace(out, pattern, "[name]") if pattern else out


def _replaced(text: Column, pattern: str, by) -> Column:
    """Each match of ``pattern`` by ``by(match)``."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern, -1)
    return F.array_join(F.transform(F.arrays_zip(between.alias("gap"), F.transform(found, by).alias("hit")), lambda x: F.concat(x["gap"], F.coalesce(x["hit"], F.lit("")))), "")


def salted_digits(digits: Column, salt: str) -> Column:
    """Digits of the same number that only the salt tells; equal ones stay equal."""
    hexed = F.concat(F.sha2(F.concat(F.lit(salt), digits), 256), F.sha2(F.concat(F.lit(salt), F.lit("+"), digits), 256))
    return F.substring(F.translate(hexed, "abcdef", "012345"), F.lit(1), F.length(digits))


def redacted(text: Column, people: dict[str, str], salt: str, endings: Sequence[str] = ()) -> Column:
    """Text without private terms: people's names become their stand-ins, other words of names "Fake", addresses of mail a fixed one,
    runs of six digits or more salted ones, card endings zeros (not inside amounts).

    ``people``: name -> stand-in. Of several names at one place the longest is taken.
    """
    names = {" ".join(n.split()): fake for n, fake in people.items() if n.strip()}
    whole = {n.upper(): fake for n, fake in names.items()}
    parts = {w.upper() for n in names for w in n.split() if len(w) >= 3} - set(whole)
    pattern = alternation([*whole, *parts])
    out = text
    if pattern:
        fakes = F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])
        fake = lambda m: F.coalesce(F.try_element_at(fakes, F.upper(F.regexp_replace(m, r"\s+", " "))), F.lit("Fake"))
        out = _replaced(out, pattern, lambda m: F.when(m == F.upper(m), F.upper(fake(m))).otherwise(fake(m)))
    out = F.regexp_replace(out, _EMAIL, "fake@example.com")
    out = _replaced(out, _LONG_DIGITS, lambda m: salted_digits(m, salt))
    if any(endings):
        out = _replaced(out, rf"(?<![\d$,.])(?:{'|'.join(sorted((e for e in endings if e), key=lambda e: (-len(e), e)))})(?!\d|\.\d)", lambda m: F.repeat(F.lit("0"), F.length(m)))
    return _replaced(out, _ENDING.replace(r"(\bending\s+(?:in\s+)?)", r"(?:\bending\s+(?:in\s+)?)"), lambda m: F.regexp_replace(m, r"\d", "0"))


def aba_ok(digits: Column) -> Column:
    """Checksum and prefix of a bank's routing number; false unless it has nine digits."""
    d = [F.substring(digits, i, 1).try_cast("int") for i in range(1, 10)]
    total = 3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]
    return F.coalesce(digits.rlike(r"^\d{9}$") & F.substring(digits, 1, 2).try_cast("int").isin(*_ABA_PREFIXES) & (total % 10 == 0), F.lit(False))
