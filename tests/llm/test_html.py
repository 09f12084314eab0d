"""Extraction from pages written by hand, odd markup, rows of all kinds, and long hostile pages in linear time."""

import time

import pytest
from sievewall.llm import html

LONG = "The river rose over night and the lower fields stood under water until the first days of spring."
MORE = "Nobody on the farm had seen it as high, and the old bridge was closed to carts for a month."

PAGES = [  # page, main text's blocks: none of these comes from the training grammar
    (f"<body><article><p>{LONG}</p></article></body>", [LONG]),
    (f"<body><p>{LONG}</p><p>{MORE}</p></body>", [LONG, MORE]),
    (f"<p>{LONG}", [LONG]),
    (LONG, [LONG]),
    (f"<div>{LONG}</div>", [LONG]),
    (f"<html><head><title>x</title><meta charset=utf-8></head><body><div id=content><p>{LONG}<p>{MORE}</div></body></html>", [LONG, MORE]),
    (f"<body><script>\"<b title='\"</script><article><p>it's so: {LONG}</p></article></body>", [f"it's so: {LONG}"]),
    (f"<body><script>var x = '<!--';</script><article><h1>Floods</h1><p>{LONG}</p></article></body>", ["Floods", LONG]),
    (f'<body><svg class="i"/><article><p>{LONG}</p><p>a <svg><path d="M0"/><text>no</text></svg> {MORE}</p></article></body>', [LONG, f"a {MORE}"]),
    (f"<div><button>Menu</div><article><p>{LONG}</p><button>more</button></article>", [LONG]),
    (f"<article><h2>Why</h2><p>1 < 2, a <b title=\"x>y\">c</b></p><p>{LONG}</p><template><p>no</p></template><select><option>a<option>b</select></article>", ["Why", "1 < 2, a c", LONG]),
    (f"<body><nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h1>Floods</h1><p>{LONG}</p><aside><p>See also: more floods</p></aside><p>{MORE}</p></article><section class=comments><p>Great!</p><p>Thanks for this</p></section><footer><p>(c) 2020</p></footer></body>", ["Floods", LONG, MORE]),
    (f"<body><header><h1>Site</h1></header><main><p>{LONG}</p><ul><li>one</li><li>two</li></ul><p>{MORE}</p></main><div class=cookie-notice><p>We use cookies to serve you</p></div></body>", [LONG, "one", "two", MORE]),
    ("<body><nav><a href=/>Home</a></nav><footer>(c)</footer></body>", []),
    (f"<body><article><p>{LONG}</p><textarea>typed <p>text</textarea><noscript>turn it on</noscript><p>{MORE}</p></article>", [LONG, MORE]),
    (f"<body><article><p>a &amp; b &#8364; &nbsp; {LONG}</p><!--> <p>{MORE}</p><!-- no --!></article>", [f"a & b € {LONG}", MORE]),
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_pages(i):
    page, blocks = PAGES[i]
    assert html.main_text(page, *html.model()) == "\n\n".join(blocks)


def test_held_out_pages_of_the_grammar():
    pages = html.training_pages(100, seed=78)
    found = html.main_texts([x for x, _ in pages], *html.model())
    assert found == [html.main_text(x, *html.model()) for x, _ in pages]
    assert sum(a == "\n\n".join(b) for a, (_, b) in zip(found, pages, strict=True)) >= 85


def test_tags_without_an_end():
    blocks = lambda x: [t for _, t in html.parse(x)[1]]
    assert blocks("a <b c") == ["a <b c"] and blocks("1 < 2 <") == ["1 < 2 <"] and blocks("") == []
    assert blocks("<p a=\"x>y</p><p>z</p>") == ["y", "z"] or blocks("<p a=\"x>y</p><p>z</p>") == ["x>y", "z"]
    assert blocks("a<title>b<p>c") == ["ab", "c"] and blocks("a<script>b<p>c") == ["a"] and blocks("a<!-- b <p>c") == ["a"]
    assert blocks("a</ b>c<!doctype x>d<?x y?>e") == ["acde"]


@pytest.mark.parametrize("unit", ["<a '", '<a x=" > "', "<a b='", "<title>", "<", "<button>", "<!-- x", "<p a='>", "<div>", "a&amp", "<select><option>"])
def test_linear_time(unit):
    began = time.process_time()
    html.parse(unit * (400_000 // len(unit)))
    assert time.process_time() - began < 20


def test_rows(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<nav><a href=/>m</a></nav>", "z"), (4, "x", "<div>" * 3000 + LONG, "z")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, html.extract(table).collect()), key=str)
    one = (1, "u", LONG, len(LONG))
    assert out == sorted([one, one, (2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0), (4, "x", LONG, len(LONG))], key=str)
    assert html.extract(table.where("false")).collect() == []
