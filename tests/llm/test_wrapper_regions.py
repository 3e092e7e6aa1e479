"""A page's region is its own, and class words don't exclude what holds the article."""

from test_wrapper_slots import texts


def test_hosts_of_mixed_templates(spark):
    pages = ["<article><h1>A</h1><p>In article</p></article><p>Beside</p>", "<div class=content><p>In content</p></div><p>Beside</p>", "<p>Plain one</p>", "<div class=post>In post</div>", "<p>Plain two</p>"]
    want = ["A\n\nIn article", "In content", "Plain one", "In post", "Plain two"]
    assert texts(spark, pages) == want
    assert texts(spark, pages, None) == want  # pages without a URL share the empty host


def test_class_words_around_the_article(spark):
    whole = "<article><h1>Title {i}</h1><p>Long text of page {i}, longer than all else</p></article>"
    plain = "<h1>Title {i}</h1><p>Long text of page {i}, longer than all else</p>"
    side = '<div class="sidebar"><p>Side {i}</p></div><div class="comments-area"><p>Nice {i}</p></div>'
    want = [f"Title {i}\n\nLong text of page {i}, longer than all else" for i in range(4)]
    for open_, close in (('<div class="has-sidebar">', "</div>"), ('<div class="no-menu">', "</div>"), ('<div class="share">', "</div>"), ('<div class="layout-sidebar-left">', "</div>")):
        for inner in (whole, plain):
            assert texts(spark, [(open_ + inner + close + side).format(i=i) for i in range(4)]) == want, (open_, inner)
    from ledgerkit.llm.html_wrapper import regions

    assert regions([("html/body.has.sidebar/p", "text", 0)]) == regions([("html/body.comments.open/p", "text", 0)]) == [0]
    assert regions([("body/div.comments/p", "much longer text", 0), ("body/p", "text", 0)]) == [-1, 0]


def test_links_of_other_pages(spark):
    listing = "<article><p><a href=x>" + "link text of a listing " * 9 + "</a></p></article>"
    assert texts(spark, [listing] * 2 + ["<article><p>Prose of this page</p></article>"]) == ["", "", "Prose of this page"]
