"""Pages read by the slots of their host's wrapper."""

import random

from ledgerkit.llm import html_wrapper
from ledgerkit.llm.html_wrapper import Automaton, collapse, infer

PAGES = "page_id long, url string, html string"


def texts(spark, pages, url="http://h.org/%d"):
    rows = [(i, url and url % i, f"<html><body>{p}</body></html>") for i, p in enumerate(pages)]
    return [r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def test_template_and_content_of_one_path(spark):
    """Template text and content share the path body/p: only the place in the wrapper tells them apart."""
    pages = [f"<p>All rights are ours.</p><h1>Title {i}</h1>" + "".join(f"<p>Word {i} {j}</p>" for j in range(1 + i % 3)) + "<hr>" * (i % 2) for i in range(9)]
    assert texts(spark, pages) == ["\n\n".join([f"Title {i}", *(f"Word {i} {j}" for j in range(1 + i % 3))]) for i in range(9)]
    assert texts(spark, [pages[1]] * 4) == ["All rights are ours.\n\nTitle 1\n\nWord 1 0\n\nWord 1 1"] * 4  # copies say nothing about templates


def test_copies_of_one_page_among_others(spark):
    """A slot that only copies of one page have is no template."""
    pages = [f"<h1>Title {i}</h1><p>Word {i}</p>" for i in range(5)] + ["<h1>Once</h1><p>More</p><blockquote>Rare</blockquote>"] * 4
    assert texts(spark, pages)[5:] == ["Once\n\nMore\n\nRare"] * 4


def test_wrapper_reads_every_stream():
    r = random.Random(5)
    for _ in range(60):
        streams = []
        for _ in range(r.randrange(1, 12)):
            s = []
            for _ in range(r.randrange(0, 6)):
                s += r.choice([["p", "#"], ["p", "#"] * r.randrange(1, 4), ["ul", *["li", "#"] * r.randrange(1, 4), "/ul"], ["div", "#", "/div"], ["img"], ["h2", "#"]])
            streams.append(tuple(s))
        automaton = Automaton(infer([collapse(s) for s in streams]))
        for s in streams:
            ids = automaton.read(list(s))
            assert ids is not None and len(ids) == s.count("#") and all(automaton.program[i][0] == "#" for i in ids)
    assert Automaton(("p", "#")).read(["h1", "#"]) is None
    assert Automaton(("h1", "#", ("+", ("p", "#")))).read(["h1", "#", "p", "#", "p", "#"]) == [1, 3, 3]
