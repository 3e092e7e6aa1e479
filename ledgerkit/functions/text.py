"""Text columns: descriptor normalisation and cleaning, names, numbers, hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_raw(c: Column) -> Column:
    """Upper case, single spaces."""
    return F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))


def normalize_alias(c: Column) -> Column:
    """Lower case, ``&`` as "and", marks dropped, all else a space."""
    text = F.regexp_replace(F.lower(c), "&", " and ")
    text = F.regexp_replace(text, r"['’.®™]", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def normalize_person(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z ]", ""), r"\s+", " "))


#: Processors that put their mark in front of a merchant's name (fixed values).
PROCESSORS = ("SQ", "TST", "SP", "PP", "PAYPAL", "PY")
#: Two-letter codes of US states (fixed values).
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()


def clean_description(c: Column) -> Column:
    """A card descriptor without processor mark, codes, phone, state, links and store numbers; the raw text if nothing is left."""
    raw = normalize_raw(c)
    t = F.regexp_replace(raw, rf"^(?:{'|'.join(PROCESSORS)}) ?\*\s*", "")
    t = F.regexp_replace(t, r"\*(?=[A-Z0-9]*\d)[A-Z0-9]+", "")
    t = F.regexp_replace(t, r"\*", " ")
    t = F.regexp_replace(t, r"\b(?:\d{3}[-.\s]?)?\d{3}[-.]\d{4}\b", " ")
    t = F.regexp_replace(t, r"\b[A-Z0-9.-]+\.(?:COM|NET|ORG)/[A-Z0-9/]*", " ")
    t = F.regexp_replace(t, r"#\s*\d+\b", " ")
    t = F.regexp_replace(t, r"(?<=[A-Z])\d{3,}\b", "")
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: ~w.rlike(r"^\d+$") & (w != ""))
    words = F.when((F.size(words) > 1) & F.element_at(words, -1).isin(*STATES), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    # Consecutive repeats collapse: each word stays unless it equals the word before it.
    words = F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))
    out = F.array_join(words, " ")
    return F.when(out == "", raw).otherwise(out)


def keywords(c: Column, stop: Sequence[str]) -> Column:
    """Distinct words of four or more letters or digits, without the stop list."""
    return F.array_except(F.array_distinct(F.filter(F.regexp_extract_all(F.upper(c), F.lit(r"([A-Z0-9]+)"), 1), lambda w: F.length(w) >= 4)), F.array(*[F.lit(s) for s in stop]))


def numbers_in(c: Column) -> Column:
    """Distinct numbers written in digits, as doubles."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d{3})", ""), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double")))


def document_text(c: Column) -> Column:
    """Typographic quotes and dashes as ASCII, marks dropped, words broken at line ends joined, lower case, single spaces."""
    t = F.translate(c, "‘’“”–—−", "''\"\"---")
    t = F.regexp_replace(t, "[®™©]", "")
    t = F.regexp_replace(t, r"(?<=\w)-\s*\n\s*(?=\w)", "")
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def host_allowed(host: Column, domains: Sequence[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


#: Query parameters that only track (fixed values).
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref")


def normalize_url(url: Column) -> Column:
    """https, host in lower case, no fragment, no tracking parameters, parameters kept in order."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^(utm_[a-z]+|{'|'.join(TRACKING)})="))
    return F.concat(F.lit("https://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def luhn_ok(digits: Column) -> Column:
    """Check digit of a card number; ``digits`` holds digits alone."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0
