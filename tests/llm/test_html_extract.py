import time

import pytest
from pyspark.sql import functions as F

from setscope.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, host int"


def page(article, extra="", nav="<nav><ul><li><a href='/'>Home</a></li></ul></nav>"):
    return (f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{a:b}}</style>'
            f'<script>var t="</p>";</script></head><body>{nav}<!-- ad > 0 -->{extra}<article>{article}</article>'
            f'<footer>&copy; me</footer></body></html>')


CASES = [
    (page("<h1>Title &amp; more</h1><p><b>One  two\n three<br><p>Four&nbsp;five</p>"), "Title & more\n\nOne two three\n\nFour five"),
    (page("<p>a</p><aside>side</aside><form><p>form</p></form><p>b</p><script>x</script>"), "a\n\nb"),
    (page('<header class="entry-header"><h1>Head</h1><p>by me</p></header><p>text</p><footer>foot</footer>'), "Head\n\ntext"),
    (page('<p>a</p><div class="comments"><article class="comment"><p>reader</p></article></div>'), "a"),
    (page("<p>a</p><article><p>a nested reply that is much longer than the text</p></article>"), "a"),
    (page('<div class="ad">buy</div><div id="cookieNotice">we use</div><p role="navigation">x</p><p>a</p>'), "a"),
    (page("<p>a <span class='share-links'>share</span>b <em>c</em>d</p>"), "a b cd"),
    (page("<ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><blockquote>q</blockquote>"), "one\n\ntwo\n\n1 2\n\n3\n\nq"),
    (page('<div class="layout has-sidebar"><p>a</p></div><p hidden>x</p><p style="display: none">y</p>'), "a"),
    (page("<p>1 < 2 && 3 > 2 &lt;b&gt; &#233; &eacute; &unknown; &#x1F600;</p>"), "1 < 2 && 3 > 2 <b> é é &unknown; 😀"),
    ("<body class='nav-open'><main><p>in main</p></main><p>outside</p></body>", "in main"),
    ("<body><header><h1>Site</h1></header><p>only body</p><nav>n</nav></body>", "only body"),
    ("just text &amp; <b>bold</b>", "just text & bold"),
    ("<article><p>unclosed <a href=\"x>y\">link</a> <p title='>'>next", "unclosed link\n\nnext"),
    ("<article><p>a</p><!-- never closed <p>b</p>", "a"),
    ("<article>x<script>never closed </article>", "x"),
    ("", ""), (None, ""), ("<", "<"), ("<article></article>", ""), ("</p></div>text", "text"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_cases(source, text):
    assert H.Page(source or "").text() == text


WHOLE = [
    ("<article><p>short</p></article><p>between</p><article><p>the longer one</p></article>", "short\n\nthe longer one"),
    ("<main><h1>Head</h1><p>by me</p><article><p>text</p></article></main><h2>out</h2>", "Head\n\ntext"),
    ("<main><h1>Head</h1><nav><h2>n</h2></nav><p>text</p></main><p>out</p>", "Head\n\ntext"),
    ("<article><p>a</p></article><article class='comment'><p>reader</p></article>", "a"),
] + [(f"<article><p>a</p><div><{tag}>in</div><p>b</p></article>", "a\n\nb")
     for tag in ("svg", "math", "object", "select", "noscript", "iframe")]


@pytest.mark.parametrize("source, text", WHOLE)
def test_all_articles_headings_of_main_and_what_follows_an_unclosed_element(source, text):
    assert H.Page(source).text() == text


def test_many_unclosed_elements_take_linear_time():
    began = time.time()
    assert H.Page("<article>" + "<svg>x " * 50_000).text().startswith("x x")
    assert time.time() - began < 10


def test_templates_are_found_per_host(spark):
    """A box without a telling name goes where it recurs on the host; paragraphs and copied articles stay."""
    box = "<div><b>Read our letter</b></div>"
    rows = [(i, f"https://a.example/{i}", page(f"<p>own {i}</p>{box}<p>shared words</p>"), "", 0) for i in range(20)]
    rows += [(100 + i, f"https://b.example/{i}", page(f"<p>other {i}</p>" + (box if i < 3 else "")), "", 0) for i in range(20)]
    rows += [(200 + i, f"https://c.example/{i}", page(f"<div>same copy</div>{box}"), "", 0) for i in range(20)]
    rows += [(300 + i, None, page(f"<p>no host {i}</p>{box}"), "", 0) for i in range(10)]
    rows += [(400, "//A.example:80/x", page(f"<p>new</p>{box}"), "", 0), (400, "//A.example:80/x", page(f"<p>new</p>{box}"), "", 0)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(20):
        assert got[i] == f"own {i}\n\nshared words"
        assert got[100 + i] == f"other {i}" + ("\n\nRead our letter" if i < 3 else "")
        assert got[200 + i] == "same copy\n\nRead our letter"
    assert got[300] == "no host 0\n\nRead our letter" and got[400] == "new"


def test_a_notice_on_a_small_part_of_a_large_host_goes(spark):
    box = "<div><b>Read our letter</b></div>"
    rows = [(i, f"https://a.example/{i}", page(f"<p>own {i}</p>" + (box if i < 30 else "<ol><li>rare</ol>" if i < 50 else "")),
             "", 0) for i in range(600)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"own {i}" + ("\n\nrare" if 30 <= i < 50 else "") for i in range(600)}


@pytest.mark.parametrize("few", [0, 10**9])
def test_both_joins_agree(spark, monkeypatch, few):
    monkeypatch.setattr(H, "BROADCAST_SUBTREES", few)
    rows = [(i, "http://x.y/", page(f"<p>own {i}</p><section>bar</section>"), "", 0) for i in range(8)] + [(9, None, None, None, 1)]
    got = sorted(H.extract(spark.createDataFrame(rows, SCHEMA)).select("page_id", "url", "text", "n_chars").collect())
    assert [tuple(r) for r in got] == [(i, "http://x.y/", f"own {i}", 5) for i in range(8)] + [(9, None, "", 0)]


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    assert H.Page("<div>" * 30_000 + "x" + "</div>" * 30_000).text() == "x"
    assert len(H.Page("<article>" + "<p>word</p>" * 50_000).text()) == 50_000 * 6 - 2
    H.Page('<a href="' * 20_000)
    H.Page("<p></q>" * 30_000)
    assert time.time() - began < 30


def test_given_pages_against_their_article_element(spark):
    """The given pages are simple enough to cut out the article by hand."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_hosts(spark):
    df = spark.createDataFrame([("HTTP://U@Www.Ex.org:8/x",), ("//h/p",), ("/p",), (None,)], "u string")
    assert [r[0] for r in df.select(H.host_of(F.col("u"))).collect()] == ["www.ex.org", "h", None, None]


def test_deep_pages_are_read_like_shallow_ones():
    for depth in (3, 100, 3000):
        page = H.Page("<article>" + "<p>one" + "<span>" * depth + "two<p>three</article><footer>x</footer>")
        assert page.text() == "onetwo\n\nthree"
        page = H.Page("<article><ul><li>a" + "<b>" * depth + "c<li>d</ul></article>")
        assert page.text() == "ac\n\nd"
