"""URL filter, revisit resolution and wrapper extraction."""

import html
import math
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
from conftest_llm import SMALL

from ledgerkit.llm import html_wrapper, url_filter, warc_revisit

PAGES = "page_id long, url string, html string, host string, path string, `a.b` string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet")


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def brute_score(counts, text):
    """Witten-Bell probabilities of a text by plain recursion over dictionaries."""
    kinds = defaultdict(set)
    totals = Counter()
    grams = Counter()
    for gram, n in counts.items():
        for i in range(len(gram)):
            context, last = gram[i:-1], gram[-1]
            totals[context] += n
            kinds[context].add(last)
            grams[context, last] += n

    def p(context, last):
        lower = p(context[1:], last) if context else 1 / 32
        t = totals[context]
        return (grams[context, last] + len(kinds[context]) * lower) / (t + len(kinds[context])) if t else lower

    c = [0, 0, 0, *[int(url_filter._CLASS[b]) for b in text.encode()], 0]
    return [math.log(p(tuple(c[i : i + 3]), c[i + 3])) for i in range(len(c) - 3)]


ODD = [
    (1, None, None, "h", "p", "z"), (2, "", "", "h", "p", "z"), (3, "no scheme/com/en/", "<p>x", "h", "p", "z"), (4, "http://A.Example.COM/en/7?x#y", "<article>é", "h", "p", "z"),
    (5, "https://de.net/de/1", "<", "h", "p", "z"), (6, "https://net/de/x", "plain", "h", "p", "z"), (7, "http://example.net/de/81", "<article><p>a", "h", "p", "z"), (8, "http://sub.org?q=/es/", "&amp;&#233;", "h", "p", "z"),
    (9, "http://x.org/es/" + "long" * 5000, "<article><p>" + "word " * 50_000, "h", "p", "z"), (9, "http://x.org/es/1", "<nav>only", "h", "p", "z"), (None, "http://b.net/de/", None, "h", "p", "z"), (10, "a://b://c/d", "x", "h", "p", "z"),
]


@pytest.mark.parametrize("which", ["odd", "pages"])
def test_url_rules_and_scores(spark, pages, which):
    frame = pages if which == "pages" else spark.createDataFrame(ODD, PAGES)
    rows = frame.collect()
    want = sorted(((r.page_id, *host_path(r.url), rule_of(*host_path(r.url))[0]) for r in rows), key=str)
    got = url_filter.filter_urls(frame).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == want
    fixed = dict(url_filter.RULES)
    for r in got:
        assert r.verdict == (fixed[r.rule] if r.rule else ("allow" if r.score >= r.threshold else "block"))


def test_url_scores_by_brute_force(spark, pages):
    from pyspark.sql import functions as F

    back = {r.page_id for r in pages.filter(F.pmod(F.xxhash64("url"), F.lit(url_filter.HELD_BACK)) == 0).collect()}
    counts = {"allow": Counter(), "block": Counter()}
    rows = pages.collect()
    for r in rows:
        h, p = host_path(r.url)
        verdict = rule_of(h, p)[1]
        if verdict and r.page_id not in back:
            c = [0, 0, 0, *[int(url_filter._CLASS[b]) for b in (h + p).encode()], 0]
            counts[verdict].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    assert counts["allow"] and counts["block"]
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for r in rows[:25]:
        text = "".join(host_path(r.url))
        want = np.mean(np.subtract(brute_score(counts["allow"], text), brute_score(counts["block"], text))) if text else 0.0
        assert got[r.page_id].score == pytest.approx(want, abs=1e-4)


def test_url_threshold_and_empty(spark):
    assert url_filter.threshold({(10, True): 5, (-10, False): 5}) == pytest.approx(-9 / 50, abs=0.4)
    assert url_filter.threshold({}) == 0.0 and url_filter.threshold({(3, True): 1}) == 0.0
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    one = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.net/de/1", "", "", "", ""), (2, "http://b/c", "", "", "", "")], PAGES)).collect()
    assert {r.verdict for r in one} == {"allow"}


def test_revisits_by_sql(spark, pages):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    want = con.execute(warc_revisit.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in warc_revisit.revisit_report(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


RECORDS = "record_id long, kind string, url string, ts double, etag string, last_modified string, digest string, headers map<string,string>, bucket string"


@pytest.mark.parametrize("bucket", [1, 2, 50_000])
def test_revisits_by_brute_force(spark, bucket):
    import random

    r = random.Random(bucket)
    rows = []
    for i in range(300):
        url = r.choice([None, "", "http://a.org/x", "https://www.A.org/x/", "http://a.org/x?utm_source=1&b=2&a=1", "a.org/x?a=1&b=2#f"])
        rows.append((i % 290, r.choice(["response", "revisit", "request"]), url, r.choice([None, *map(float, range(20))]), r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "d1", "d2"]), f"dig{i}", r.choice([None, {}, {"etag": "e", "x": "1"}, {"date": "t", "x": "2"}]), "z"))
    canon = {None: "", "": "", "http://a.org/x": "a.org/x", "https://www.A.org/x/": "a.org/x", "http://a.org/x?utm_source=1&b=2&a=1": "a.org/x?a=1&b=2", "a.org/x?a=1&b=2#f": "a.org/x?a=1&b=2"}
    want = []
    for rid, kind, url, ts, etag, lm, _, headers, _ in rows:
        if kind != "revisit":
            continue
        able = [o for o in rows if o[1] == "response" and canon[o[2]] == canon[url] != "" and o[3] is not None and ts is not None and o[3] < ts]
        o = max(able, key=lambda o: (o[3], o[0]), default=None)
        if o is None:
            want.append((rid, canon[url], "no_original", None, None))
            continue
        weak = lambda t: re.sub("^W/", "", t)
        same = weak(etag) == weak(o[4]) if etag and o[4] else (lm == o[5] if lm and o[5] else None)
        state = "no_validator" if same is None else "resolved" if same else "modified"
        merged = {**(o[7] or {}), **{k: v for k, v in (headers or {}).items() if k in warc_revisit.PERMITTED}}
        want.append((rid, canon[url], state, o[0] if same else None, str(sorted(merged.items())) if same else None))
    got = warc_revisit.resolve_revisits(spark.createDataFrame(rows, RECORDS), bucket).collect()
    got = [(x.record_id, x.canonical_url, x.state, x.refers_to, None if x.headers is None else str(sorted(x.headers.items()))) for x in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc_revisit.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def article(page):
    """Headings and paragraphs of the article, by pattern: enough for the generated pages."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", body[1]) if body else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_wrapper.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_main_text_by_joined_models(spark, pages, monkeypatch):
    want = sorted(map(tuple, html_wrapper.main_text(pages).collect()))
    monkeypatch.setattr(html_wrapper, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html_wrapper.main_text(pages).collect())) == want


def test_main_text_odd(spark):
    chrome = '<header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div>'
    tail = '<form>Mail <input></form><div class="comments"><p>Nice!</p></div><aside>More</aside><footer>Foot</footer><script>var a="<p>no</p>"</script>'
    rows = [(i, "http://h.org/%d" % i, f"<html><head><title>T</title></head><body>{chrome}<main><h1>Title {i}</h1><p>One&nbsp;&amp; <b>two</b>\n {i}</p><ul><li>item {i}<li>second</ul>{tail}</main></body></html>", "", "", "") for i in range(20, 26)]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Title {i}\n\nOne & two {i}\n\nitem {i}\n\nsecond" for i in range(20, 26)}
    odd = html_wrapper.main_text(spark.createDataFrame(ODD, PAGES)).collect()
    assert len(odd) == len(ODD)
    by = {r.page_id: r.text for r in odd if r.page_id not in (9, None)}
    assert by[1] == by[2] == "" and by[4] == "é" and by[7] == "a"
    assert max(r.n_chars for r in odd) == 50_000 * 5 - 1
    assert html_wrapper.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_wrappers_are_union_free():
    a = html_wrapper.collapse(("ul", "li", "#", "li", "#", "/ul"))
    assert a == ("ul", ("+", ("li", "#")), "/ul")
    b = html_wrapper.collapse(("ul", "li", "#", "/ul"))
    assert html_wrapper.align(a, b) == a
    assert html_wrapper.align(("p", "#", "/div"), ("p", "#", "img", "/div")) == ("p", "#", ("?", ("img",)), "/div")
