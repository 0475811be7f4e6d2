import html
import re
import time

import pytest

from etlvault.llm.common import read
from etlvault.llm.html_text import Page, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>slogan</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this page to track you all day long, please agree.</div>
<div id=content><h1>The  head&shy;line</h1><div class=body><p>First <b>bold &lt;tag&gt;</b> paragraph with a <a href=/x>link</a> inside,
going on for a while.<p>Second&nbsp;one &eacute;&#233;&#xe9; without end tag<br>after a break, also long enough to count as text.
<ul><li>point one is a longer item<li>point two is also one</ul><script>if (a < b) document.write("<p>no</p>");</script>
<blockquote>A quotation that matters.</blockquote></div></div>
<aside>Sidebar words</aside><section class="comments"><p>A reader writes a very long comment about all of this, longer than most paragraphs here.</p></section>
<form><p>Name <input></p></form><footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == ("The head\xadline\nFirst bold <tag> paragraph with a link inside, going on for a while.\n"
                               "Second one ééé without end tag after a break, also long enough to count as text.\n"
                               "point one is a longer item\npoint two is also one\nA quotation that matters.")


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("  \n ", ""), ("plain &amp; text", "plain & text"), ("<p>one<p>two", "one\ntwo"), ("<div>a</b></i></div></div>b", "a\nb"),
    ("<article><p>x < y & z</p></article>", "x < y & z"), ("<p a='>'>q</p><!-- <p>no</p> -->", "q"), ("<!-- never closed <p>x</p>", ""),
    ("<script>only()", ""), ("<nav><p>menu</p></nav>", ""), ("<article><h1>H</h1><p><b>H<br><p>Text.</p></article>", "H\nH\nText."),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<main><p hidden>no</p><p>yes</p><div class='ad'>buy</div></main>", "yes"),
])
def test_small(page, want):
    assert main_text(page) == want


def test_deep_and_hostile_pages():
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("</p></b>" * 50_000 + "<p>end") == "end"
    assert main_text("<b><i>" * 20_000 + "end") == "end"
    assert main_text("<p>x</p>" * 30_000).count("x") == 30_000
    main_text('<a "' * 3_000)


def test_density_by_hand():
    page = Page("<body><div><p>12345</p><p>123 <a href=#>45</a></p></div></body>")
    density = page.densities()
    assert page.names == ["#root", "body", "div", "p", "p"]
    assert page.chars == [10, 10, 10, 5, 5] and page.link_chars == [2, 2, 2, 0, 2] and page.tags == [5, 5, 4, 1, 2] and page.link_tags == [1, 1, 1, 0, 1]
    assert density[3] > density[4] > 0


def test_real_pages(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert [" ".join(x.split()) for x in got[r.page_id].split("\n")] == [b for b in blocks if b]


def test_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (2, None, "<p>x", "old"), (2, None, "<p>x", "old"), (3, "", "<p>" + "y " * 200_000, "")], "page_id long, url string, html string, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text"] and [len(r.text) for r in got.orderBy("page_id").collect()] == [0, 1, 1, 399_999]
    assert extract(pages.limit(0)).count() == 0


def test_sibling_articles():
    """Every article that reaches the threshold stays, not only the one with the largest sum; a list of links does not."""
    post = "<article><h2>Post {0}</h2>" + "<p>A paragraph of part {0} that goes on for a good while.</p>" * 9 + "</article>"
    page = "<body><div>" + "".join(post.format(i) for i in range(4)) + "</div><div>" + "<p><a href=#>link</a></p>" * 9 + "</div></body>"
    got = main_text(page)
    assert [(f"Post {i}" in got, got.count(f"paragraph of part {i}")) for i in range(4)] == [(True, 9)] * 4 and "link" not in got


WRAPPERS = ["layout has-sidebar", "content-with-sidebar", "no-comments", "page-with-menu", "post-related-content", "post social-studies", "widget"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("depth", [1, 3])
def test_names_do_not_empty_a_page(name, depth):
    article = "<h2>Title</h2>" + "<p>A sentence of the article that is long enough to be counted as text.</p>" * 18
    page = f"<body><nav><a href=/>Home</a></nav>{f'<div class={chr(34)}{name}{chr(34)}>' * depth}{article}{'</div>' * depth}<div class=sidebar><p>More</p></div></body>"
    got = main_text(page)
    assert got.count("A sentence of the article") == 18 and "Home" not in got and "More" not in got


def test_long_reader_comments_stay_out():
    page = "<body><article><h1>H</h1><p>A short article.</p></article><div class=comments>" + "<p>A reader goes on and on about it.</p>" * 40 + "</div></body>"
    assert main_text(page) == "H\nA short article."


def test_the_text_of_a_formula_stays():
    assert main_text("<p>Let <math><mi>x</mi><annotation>x_tex</annotation></math> be 5</p>") == "Let x be 5"


@pytest.mark.parametrize("part", ["<a href='", '<a "', "<a", "<!", "</", "<!--", "<", "<a href='>", '<a ">', "<div class='menu'>", "<script>"])
def test_broken_pages_take_linear_time(part):
    started = time.perf_counter()
    main_text(part * (1_000_000 // len(part)))
    main_text(part * (1_000_000 // len(part)) + ">")
    assert time.perf_counter() - started < 20
