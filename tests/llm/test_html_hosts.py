"""What a host's wrapper decides about its pages' articles, and what it must leave alone."""

import random

import pytest

from fleetledger.llm import html_extract

WORDS = ("river", "stone", "cloud", "forest", "harbour", "meadow")


def texts(spark, pages):
    rows = [(i, "http://h/", p) for i, p in enumerate(pages)]
    df = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [t for _, t in sorted((r.page_id, r.text) for r in df.collect())]


def test_all_articles_of_a_page(spark):
    pages = [f"<body><main><article class=lead><p>Lead of {w}</p></article><p>between</p><article class=body><p>Body of {w}, which is longer</p></article></main></body>" for w in WORDS]
    assert texts(spark, pages) == [f"Lead of {w}\nBody of {w}, which is longer" for w in WORDS]


@pytest.mark.parametrize("rows", [3, 5, 9, 15, 40])
def test_template_goes_however_many_rows_a_page_has(spark, rows):
    """Mixed blocks between a greeting and a notice that all pages have; no article is named."""
    rng = random.Random(rows)

    def page(w):
        parts = [rng.choice([f"<p>{w} text {k} {rng.random()}</p>", f"<blockquote>{w} said {k}</blockquote>", f"<pre>{w} {k}</pre>", f"<h3>{w} head {k}</h3>", f"<ul><li>{w} item {k}</li></ul>"]) for k in range(rows * 3)]
        return f"<body><div id=all><p>Welcome to all of our pages</p>{''.join(parts)}<p>All rights are ours alone</p></div></body>"

    for text, w in zip(texts(spark, [page(w) for w in WORDS]), WORDS, strict=True):
        assert "Welcome" not in text and "rights" not in text
        assert len(text.split("\n")) == rows * 3 and all(w in line for line in text.split("\n"))


def test_headings_and_own_lists_stay(spark):
    """Equal headings on all pages, and a list of links within the text, are the article's; a menu before it is not."""
    page = lambda w: f"<body><div class=x><ul><li><a href=/1>Home</a></li><li><a href=/2>About us</a></li></ul><h2>Introduction</h2><p>Of {w} we speak.</p><h2>Methods</h2><p>How {w} is seen.</p><ul><li><a href=/{w}>Map of {w}</a></li><li><a href=/s>Source</a></li></ul><h2>Results</h2><p>What {w} is.</p><p>Copyright by us</p></div></body>"
    want = [f"Introduction\nOf {w} we speak.\nMethods\nHow {w} is seen.\nMap of {w}\nSource\nResults\nWhat {w} is." for w in WORDS]
    assert texts(spark, [page(w) for w in WORDS]) == want


@pytest.mark.parametrize("name", ["discussion", "related", "notice", "search", "social", "alert alert-info"])
def test_names_that_mislead_are_held_against_the_wrapper(spark, name):
    """One block of such a name holds each article's own text, another the same line everywhere: only the second goes."""
    page = lambda w: f"<body><article><h1>The {w}</h1><section class='{name}'><p>We ask what a {w} means.</p></section><p>More of the {w}.</p><div class='{name}'><p>Sign up for our letters</p></div></article></body>"
    pages = [page(w) for w in WORDS]
    assert texts(spark, pages) == [f"The {w}\nWe ask what a {w} means.\nMore of the {w}." for w in WORDS]
    for p in pages:  # without the host's wrapper the line stays
        assert "Sign up" in html_extract.main_text(html_extract.parse(p), html_extract.Rule())


def test_lists_of_links_by_name_go(spark):
    page = lambda w: f"<body><article><p>Of {w}.</p><div class=related><a href=/a>More {w} here</a> <a href=/b>And {w} there</a></div></article></body>"
    assert texts(spark, [page(w) for w in WORDS]) == [f"Of {w}." for w in WORDS]


def test_template_line_in_an_article_without_a_name_stays(spark):
    """An article says itself what its text is: a line that is on every page, such as a licence, is part of it."""
    page = lambda w: f"<body><article><p>Of {w}.</p><p>Free to share.</p></article></body>"
    assert texts(spark, [page(w) for w in WORDS]) == [f"Of {w}.\nFree to share." for w in WORDS]


def test_anchors_keep_the_order_of_both_levels():
    item = lambda h: ["p", 0, 0, 1, h, 0, []]
    pairs = html_extract.anchors([item(h) for h in (1, 2, 3, 4, 5, 5)], [item(h) for h in (3, 1, 2, 5, 4)])
    assert pairs == [(0, 1), (1, 2), (3, 4)]
