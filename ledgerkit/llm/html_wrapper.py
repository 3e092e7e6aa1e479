"""HTML main text by union-free wrappers inferred for each host.

A page is a stream of block tags and text slots (inline tags belong to the text around them; end tags
that HTML lets authors omit are dropped). Adjacent repeats become repeated groups ``( ... )+``. The streams
of a host are aligned one after another: what both have stays, a mismatch becomes an optional group
``( ... )?``, and a group seen once in one stream and repeatedly in the other becomes a repeated group. The
result, a regular expression without unions, is the host's wrapper. Every page is then read by its host's
wrapper, as an automaton that gives each text the slot it stands in, and figures are kept by slot. A slot
outside of an article element with one text on all pages that have it belongs to the template, and one whose
text is mostly links is a list of links. Of a page's other slots, those in the page's own highest region that aren't
navigation, notices, adverts, forms or comments are content.

Scale: pages of one stream are counted together in each task before the shuffle, so a host with a third
of all pages sends a few distinct streams, not pages. Streams are first aligned in groups of a host, then the
groups' wrappers are aligned. Pages are parsed three times: for the streams, for the slots' figures and for the
text. Models are broadcast when they are few, joined by host when they aren't. No page is sampled or cut.

Defined results: null or empty html, or html without content, gives empty text of 0 characters; unclosed
elements end with their container; a null URL or one without host belongs to the empty host; repeated rows
are read each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.llm.common import discard, materialise
from ledgerkit.llm.url_filter import host_and_path

SLOT = "#"
#: Streams that are aligned in one group of a host before groups are merged.
GROUPS = 16
#: Models, and characters of wrappers, that are broadcast; with more pages are joined by host.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 16 << 20
#: A text shared by all pages of a host is template text when there are so many pages.
TEMPLATE_PAGES = 3
#: Share of a slot's characters in links from which on it is a list of links.
LINK_SHARE = 0.6
_LONGEST_PERIOD = 12
#: Places of the automata that a worker keeps.
_MOST_PLACES = 200_000

# A tag's attributes, quoted ones whole. Their number and lengths are bounded and taken for good, so that a tag that never
# closes costs a bounded look ahead; tags beyond that end at their first bracket.
_ATTRIBUTES = r"(?:[^>\"']{0,1024}(?:\"[^\"]{0,8192}\"|'[^']{0,8192}')){0,200}+[^>\"']{0,1024}+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|math|iframe)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]{{0,1024}}>", re.S | re.I
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's inline elements, void elements, and elements whose end tags may be omitted.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base col embed hr input link meta param source track".split())
_IMPLIED = frozenset("p li dt dd tr td th option thead tbody tfoot colgroup".split())
_OUTSIDE_TAGS = frozenset("nav footer aside form head menu button select dialog object audio video canvas fieldset datalist".split())
_OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments reply replies respond disqus social share sharing related recommended newsletter subscribe signup login search widget pagination pager toolbar complementary contentinfo dialog".split()
)
_MODIFIERS = frozenset("has no with without".split())
_ARTICLE_WORDS = frozenset("article content post entry story main".split())


def _names(attributes: str) -> tuple[str, ...]:
    words = []
    for m in _ATTRIBUTE.finditer(attributes):
        words += [w.lower() for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
    return tuple(dict.fromkeys(words))


def parse(page: str | None):
    """Yield (token, path, text, link characters): a block tag with empty text, or a slot with its text.

    ``path`` is the chain of open blocks as ``tag.word.word/...``.
    """
    stack: list[str] = []
    parts: list[str] = []
    linked, link, at = 0, 0, 0
    out = []

    def flush():
        nonlocal linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((SLOT, "/".join(stack), text, min(linked, len(text))))
        linked = 0

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (link > 0)
        at = m.end()
        end, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        tag = (name or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                link = max(0, link + (-1 if end else 1))
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if end:
            names = [s.split(".")[0] for s in stack]
            if tag in names:
                while stack and stack.pop().split(".")[0] != tag:
                    pass
                if tag not in _IMPLIED:
                    out.append(("/" + tag, "/".join(stack), "", 0))
            continue
        if tag in _IMPLIED and stack and stack[-1].split(".")[0] in _IMPLIED:
            while stack and stack[-1].split(".")[0] in _IMPLIED and (stack[-1].split(".")[0] == tag or stack[-1].split(".")[0] == "p" or tag in ("tr", "tbody", "tfoot")):
                stack.pop()
        elif stack and stack[-1].split(".")[0] == "p":
            stack.pop()  # a block ends a paragraph
        key = ".".join((tag, *_names(attributes or "")))
        out.append((key, "/".join(stack), "", 0))
        if tag not in _VOID and not (attributes or "").rstrip().endswith("/"):
            stack.append(key)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


# A wrapper is a tuple of items; an item is a token or ("+", items) or ("?", items).


def collapse(items: tuple) -> tuple:
    """Adjacent repeats become repeated groups, shortest period first, until nothing repeats."""
    while True:
        before = items
        for period in range(1, _LONGEST_PERIOD + 1):
            out, i = [], 0
            while i < len(items):
                group = items[i : i + period]
                n = 1
                while items[i + n * period : i + (n + 1) * period] == group and len(group) == period:
                    n += 1
                if n > 1 and not (period == 1 and isinstance(group[0], tuple) and group[0][0] == "+"):
                    item = ("+", group)
                    if not out or out[-1] != item:
                        out.append(item)
                    i += n * period
                elif period == 1 and out and out[-1] == group[0] and isinstance(group[0], tuple) and group[0][0] == "+":
                    i += 1
                else:
                    out.append(items[i])
                    i += 1
            items = tuple(out)
        if items == before:
            return items


def _as_groups(items: tuple, groups: set) -> tuple:
    """Each single occurrence of the content of a known repeated group becomes the group."""
    for group in sorted(groups, key=len, reverse=True):
        out, i = [], 0
        while i < len(items):
            if items[i : i + len(group)] == group:
                out.append(("+", group))
                i += len(group)
            else:
                out.append(items[i])
                i += 1
        items = tuple(out)
    return collapse(items)


def _flat(items: tuple) -> list:
    """(item, optional) without optional groups."""
    return [x for item in items for x in (((i, True) for i in item[1]) if isinstance(item, tuple) and item[0] == "?" else ((item, False),))]


def align(a: tuple, b: tuple) -> tuple:
    """The wrapper of two wrappers: longest common subsequence; what one lacks becomes optional."""
    if a == b:
        return a
    groups = {i[0][1] for x in (a, b) for i in _flat(x) if isinstance(i[0], tuple)}
    x, y = (_flat(_as_groups(w, groups)) for w in (a, b))
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            out.append((x[i][0], x[i][1] or y[j][1]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((x[i][0], True))
            i += 1
        else:
            out.append((y[j][0], True))
            j += 1
    merged: list = []
    for item, optional in out:
        if optional and merged and isinstance(merged[-1], tuple) and merged[-1][0] == "?":
            merged[-1] = ("?", (*merged[-1][1], item))
        else:
            merged.append(("?", (item,)) if optional else item)
    return tuple(merged)


def infer(streams: list[tuple]) -> tuple:
    """Align the streams, the most frequent first (the caller's order)."""
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    return wrapper


def _pack(items: tuple) -> str:
    return json.dumps(items)


def _unpack(text: str) -> tuple:
    def back(x):
        return tuple(back(i) for i in x) if isinstance(x, list) else x

    return back(json.loads(text))


class Automaton:
    """A wrapper that reads token streams. A slot's id is its place in the program, for all passes of a repeated group."""

    def __init__(self, items: tuple):
        self.program: list = []  # (token, or None for a branch; next places, the preferred first)
        self._emit(items)
        self.end = len(self.program)
        self._steps: dict = {}

    def _emit(self, items: tuple):
        program = self.program
        for item in items:
            if not isinstance(item, tuple):
                program.append((item, (len(program) + 1,)))
            elif item[0] == "+":
                start = len(program)
                self._emit(item[1])
                program.append((None, (start, len(program) + 1)))
            else:  # align() joins neighbours that came from different streams, so each of them may lack
                for one in item[1]:
                    branch = len(program)
                    program.append(None)
                    self._emit((one,))
                    program[branch] = (None, (branch + 1, len(program)))

    def __len__(self):
        return len(self.program) + len(self._steps)

    def _step(self, place: int, token: str | None) -> tuple:
        """Places of the token right after a place (-1: before all); for None the end."""
        out = self._steps.get((place, token))
        if out is None:
            found, seen, stack = [], set(), [0] if place < 0 else [*self.program[place][1]]
            while stack:
                at = stack.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at == self.end:
                    if token is None:
                        found.append(at)
                elif self.program[at][0] is None:
                    stack += reversed(self.program[at][1])
                elif self.program[at][0] == token:
                    found.append(at)
            out = self._steps[place, token] = tuple(found)
        return out

    def read(self, tokens: list[str]) -> list[int] | None:
        """Ids of the slots that the stream's texts stand in; None if the wrapper doesn't fit the stream."""
        threads: dict = {-1: None}
        for token in tokens:
            after: dict = {}
            for place, path in threads.items():
                for at in self._step(place, token):
                    if at not in after:
                        after[at] = (at, path) if token == SLOT else path
            threads = after
        for place, path in threads.items():
            if self._step(place, None):
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                return ids[::-1]
        return None


@lru_cache(20_000)
def _place(path: str) -> tuple[bool, tuple[str, ...], int]:
    """(within an element that never holds article text, ancestors that hold none by their class words, region)."""
    nodes, article, worded = path.split("/"), False, []
    for i, node in enumerate(nodes):
        tag, *names = node.split(".")
        article = article or tag in ("article", "main")
        if tag in _OUTSIDE_TAGS or (tag == "header" and not article):
            return True, (), 0
        # What follows a modifier (has-sidebar) isn't what the element is; a page's root is never a part of it.
        words = [n for before, n in zip(["", *names], names) if before not in _MODIFIERS]
        if tag not in ("html", "body") and (_OUTSIDE_WORDS.intersection(words) or ("header" in words and not article)):
            worded.append("/".join(nodes[: i + 1]))
    return False, tuple(worded), _region(path)


def _region(path: str) -> int:
    """2 within article or main, 1 within an element named like one, else 0."""
    nodes = [n.split(".") for n in path.split("/")]
    if any(n[0] in ("article", "main") for n in nodes):
        return 2
    return 1 if any(_ARTICLE_WORDS.intersection(n[1:]) for n in nodes) else 0


def _holds_article(ancestor: str, paths: list[str]) -> bool:
    """It is the page's outermost article, or holds a heading of the page or an element named like an article."""
    *above, last = ancestor.split("/")
    if last.split(".")[0] in ("article", "main") and _region("/".join(above)) < 2:
        return True
    for path in paths:
        for node in path[len(ancestor) + 1 :].split("/"):
            tag, *names = node.split(".")
            if tag == "h1" or ((tag in ("article", "main") or _ARTICLE_WORDS.intersection(names)) and not _OUTSIDE_WORDS.intersection(names)):
                return True
    return False


def regions(texts: list[tuple[str, str, int]]) -> list[int]:
    """For each (path, text, link characters) of a page its region, or -1 outside of what can be article text.

    Class words put an element outside, unless it holds most of the page's own text and its article.
    """
    places = [_place(path) for path, _, _ in texts]
    holds: dict = dict.fromkeys(w for _, worded, _ in places for w in worded)
    if holds:
        total = sum(len(text) - links for _, text, links in texts)
        for w in holds:
            inside = [t for t in texts if t[0] == w or t[0].startswith(w + "/")]
            holds[w] = 2 * sum(len(text) - links for _, text, links in inside) > total and _holds_article(w, [t[0] for t in inside])
    return [-1 if outside or not all(holds[w] for w in worded) else region for outside, worded, region in places]


def _survey(batches):
    """A host's stream and its pages, combined within a batch."""
    for batch in batches:
        streams: dict = defaultdict(int)
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            streams[host, _pack(collapse(tuple(t[0] for t in parse(page))))] += 1
        columns = list(zip(*((h, s, n) for (h, s), n in streams.items()))) or [()] * 3
        types = [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "item", "pages"])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["pages", "item"], ascending=[False, True])
    wrapper = infer([_unpack(s) for s in rows["item"]])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "item": [_pack(wrapper)], "pages": [int(rows["pages"].sum())]})


class _Known:
    """Automata of the wrappers met last, forgotten together at ``_MOST_PLACES`` places."""

    def __init__(self):
        self.automata: dict = {}
        self.size = 0

    def read(self, wrapper: str | None, tokens: list) -> list:
        """(slot id, path, text, link characters) of a page's texts; id -1 without a wrapper that fits."""
        texts = [t for t in tokens if t[0] == SLOT]
        automaton = self.automata.get(wrapper)
        if automaton is None:
            if self.size > _MOST_PLACES:
                self.automata, self.size = {}, 0
            automaton = self.automata[wrapper] = Automaton(_unpack(wrapper or "[]"))
            self.size += len(automaton)
        before = len(automaton)
        ids = automaton.read([t[0] for t in tokens])
        self.size += len(automaton) - before
        return [(i, *t[1:]) for i, t in zip([-1] * len(texts) if ids is None else ids, texts)]


def _figures(batches):
    """Of each host, slot and inside (1 in an article): its figures, combined within a batch. batches: html, host, wrapper."""
    known = _Known()
    for batch in batches:
        found: dict = {}
        for page, host, wrapper in batch:
            slots = known.read(wrapper, parse(page))
            here, whole = {}, 0
            for (slot, _, text, links), region in zip(slots, regions([t[1:] for t in slots])):
                if region >= 0:
                    data = text.encode("utf-8", "surrogatepass")
                    whole = zlib.crc32(data, whole)
                    s = here.setdefault((host, slot, int(region == 2)), [0, 0, 0])
                    s[0] += len(text)
                    s[1] += links
                    s[2] = zlib.crc32(data, s[2])
            for key, (chars, links, crc) in here.items():
                f = found.setdefault(key, [0, 0, 0, crc, crc, whole, whole])
                f[0] += 1
                f[1] += chars
                f[2] += links
                f[3], f[4], f[5], f[6] = min(f[3], crc), max(f[4], crc), min(f[5], whole), max(f[6], whole)
        columns = list(zip(*((*k, *v) for k, v in found.items()))) or [()] * 10
        types = [pa.string(), *[pa.int64()] * 9]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "slot", "inside", "pages", "chars", "links", "low", "high", "page_low", "page_high"])


def _with_models(rows: DataFrame, models: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run() over batches, lists of rows' own columns, host and the model's columns: broadcast, or joined by host."""
    size = models.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("wrapper")).alias("bytes")).first()
    own = rows.columns
    if size.n <= BROADCAST_HOSTS and (size.bytes or 0) <= BROADCAST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in models.select("host", *columns).collect()})  # at most BROADCAST_HOSTS rows
        none = (None,) * len(columns)

        def batches(it):
            for batch in it:
                table = batch.to_pydict()
                yield [(*r, *shared.value.get(h, none)) for h, r in zip(table["host"], zip(*(table[c] for c in own)))]
    else:
        rows = rows.join(models.select("host", *columns), "host", "left").select(*own, *columns)

        def batches(it):
            for batch in it:
                yield list(zip(*(c.to_pylist() for c in batch.columns)))

    return rows.mapInArrow(lambda it: run(batches(it)), schema)


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (JSON), template and lists (codes of its slots: 2 * id + inside)."""
    host = host_and_path()[0].alias("host")
    survey = pages.select(host, "html").mapInArrow(_survey, "host string, item string, pages long")
    merged = survey.groupBy("host", "item").agg(F.sum("pages").alias("pages"))
    part = F.pmod(F.xxhash64("item"), F.lit(GROUPS)).alias("part")
    schema = "host string, item string, pages long"
    streams = merged.select("host", part, "item", "pages").groupBy("host", "part").applyInPandas(_merge, schema)
    found = materialise(streams.groupBy("host").applyInPandas(_merge, schema).select("host", F.col("item").alias("wrapper")), "html-wrappers")
    figures = _with_models(pages.select("html", host), found, ["wrapper"], _figures, "host string, slot long, inside long, pages long, chars long, links long, low long, high long, page_low long, page_high long")
    least, most = [F.min(c).alias(c) for c in ("low", "page_low")], [F.max(c).alias(c) for c in ("high", "page_high")]
    figures = figures.filter("slot >= 0").groupBy("host", "slot", "inside").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")], *least, *most)
    # What stands in the article itself is the article's. Where the whole page is the same too, the pages are copies.
    template = (F.col("inside") == 0) & (F.col("pages") >= TEMPLATE_PAGES) & (F.col("low") == F.col("high")) & (F.col("page_low") < F.col("page_high"))
    code = F.col("slot") * 2 + F.col("inside")
    lists = F.col("links") >= LINK_SHARE * F.col("chars")
    judged = figures.groupBy("host").agg(F.collect_list(F.when(template, code)).alias("template"), F.collect_list(F.when(lists, code)).alias("lists"))
    out = materialise(found.join(judged, "host", "left"), "html-models")
    discard(found)
    return out


def extract(slots: list, template, lists) -> str:
    """Main text of a page, from its slots: those of the page's own highest region that are neither template nor list of links."""
    able, chars, linked = [], defaultdict(int), defaultdict(int)
    for _, path, text, links in slots:
        chars[path] += len(text)
        linked[path] += links
    for (slot, path, text, _), region in zip(slots, regions([t[1:] for t in slots])):
        code = 2 * slot + (region == 2)
        # A slot that lists links on other pages may hold prose on this one.
        if region >= 0 and code not in template and not (code in lists and linked[path] >= LINK_SHARE * chars[path]):
            able.append((region, text))
    most = max((region for region, _ in able), default=0)
    return "\n\n".join(text for region, text in able if region == most)


def _extract(batches):
    known = _Known()
    for batch in batches:
        texts = [extract(known.read(wrapper, parse(page)), set(template or ()), set(lists or ())) for _, _, page, _, wrapper, template, lists in batch]
        ids, urls = [r[0] for r in batch], [r[1] for r in batch]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_and_path()[0].alias("host"))
    return _with_models(rows, wrappers(pages), ["wrapper", "template", "lists"], _extract, "page_id long, url string, text string, n_chars long")
