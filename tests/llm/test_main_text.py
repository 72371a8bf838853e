"""Extraction on pages with every kind of furniture, broken markup and odd rows."""

import pytest

from cladescope.llm import main_text as M

PARA = "This is a sentence of the article, with commas, and enough words to count as text."
FURNITURE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name, that is long enough to score, surely</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and this notice is as long as a paragraph, sadly for all of us here.</p></div>
<div id="sidebar"><p>Popular, trending, and other posts that nobody asked for, listed at length here.</p></div>
{body}
<div class="ad">Buy now, this is an advert, really, it is one that goes on and on.</div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I disagree, strongly, with the article, and want everyone to know it now.</p></div></section>
<form><label>Mail</label><input name="x"><textarea>text, in, a, form, that, should, not, count, at all</textarea></form>
<footer>&copy; site, all rights reserved, and some more words to make it long enough.</footer></body></html>"""


def test_furniture_goes():
    want = f"Title {PARA} {PARA} A & B – “q” {PARA}"
    inner = f"<h1>Title</h1><p>{PARA}</p>\n\n<p>{PARA}<p>A &amp; B &#8211; &ldquo;q&rdquo; {PARA}"
    for body in (f"<article>{inner}</article>", f"<main>{inner}</main>", f'<div class="content">{inner}</div>', f"<div><div><div id='x'>{inner}</div></div></div>"):
        assert M.extract(FURNITURE.format(body=body)) == want


def test_sections_and_inline_marks():
    body = f"<article><header><h1>Head</h1></header><section><p>{PARA}</p></section><section><h2>Sub</h2><p>Sh<b>or</b>t <a href=x>link</a><br>line</p><ul><li>one</li><li>two</li></ul><pre>a  b\n c</pre></section><aside>aside</aside></article>"
    assert M.extract(FURNITURE.format(body=body)) == f"{PARA} Sub Short link line one two a b c"


def test_broken_markup():
    assert M.extract("<article><p>open " + PARA) == "open " + PARA
    assert M.extract("just text, no markup at all") == "just text, no markup at all"
    assert M.extract("a < b and c > d") == "a < b and c > d"
    assert M.extract("<p>x</p></div></b><p>y") == "x y"
    assert M.extract("<article><script>unclosed " + PARA) == ""
    assert M.extract("<div" + " a" * 5000) == ""
    assert M.extract("<b>" * 3000 + PARA) == PARA
    assert M.extract("<!-- x --><![CDATA[y]]><p>z &nosuch; &#x41;</p>") == "z &nosuch; A"


def test_documents(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    import re

    for html in pages["html"]:
        text = M.extract(html)
        body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        from html import unescape

        want = " ".join(unescape(re.sub(r"<(?:b|/b)>", "", re.sub(r"<(?:p|/p|br|h1|/h1)>", " ", body))).split())
        assert text == want


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", f"<p>{PARA}</p>"), (3, "u", f"<p>{PARA}</p>"), (4, "u", "<p>" + "word, " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.n_chars, r.n_chars == len(r.text)) for r in M.main_texts(pages).collect())
    assert got == [(0, 1, True), (1, 0, True), (2, 0, True), (3, len(PARA), True), (3, len(PARA), True), (4, 599_999, True)]
    assert M.main_texts(pages.limit(0)).count() == 0


def test_states_in_names_keep_the_article():
    inner = f"<h1>Title</h1><p>{PARA}</p><p>{PARA}</p>"
    want = f"Title {PARA} {PARA}"
    assert M.extract(f"<html class='cookie-consent'><body class='single comments-open'><article class='post has-comments'>{inner}</article></body></html>") == want
    for mark in ("single comments-open", "cookie-consent", "no-comments", "reply", "advert"):
        for tag in ("html", "body", "main", "article"):
            page = f"<html><body><main><article>{inner}</article></main></body></html>".replace(f"<{tag}>", f"<{tag} class='{mark}'>")
            assert M.extract(page) == want, (tag, mark)
    assert M.extract(f"<body><div class='post has-comments'>{inner}</div></body>") == want
    for furniture in ("<div class='comment-body'>", "<div class='cookie-consent'>", "<section id='comments' class='container'>", "<article class='comment'>"):
        close = furniture[1:].split()[0]
        assert M.extract(f"<body><article>{inner}{furniture}<p>{PARA}</p></{close}></article></body>") == want, furniture


@pytest.mark.parametrize(
    ("tag", "text"),
    [
        ('<p title="a" b">', "hello"), ("<p data-x=don't>", "hello"), ('<p title="a>', "hello"), ("<p title='a > b'>", "hello"), ("<p a=b=c / x>", "hello"),
        ('<p =">', "hello"), ("<p\n\tclass = 'x'\n>", "hello"), ("<p / >", "hello"), ("<!--> --><p>", "--> hello"), ("<p a==>", "hello"),
    ],
)
def test_tags_end_as_in_browsers(tag, text):
    assert M.extract(f"<article>{tag}hello</p></article>") == text


def test_names_are_read_whole():
    body = "The treatment was well borne by most, though some of them, as ever, were not sure of it."
    for name in ("side-effects", "notice-period", "share-price", "adult", "header-file", "commentary", "searchlight"):
        assert M.extract(f"<article><p>{body}</p><div class='{name}'><p>More of it.</p></div></article>") == f"{body} More of it.", name
    for name in ("sidebar", "sidebar-left", "cookie-banner", "site-nav", "adSlot", "comment-list", "newsletter_signup", "related-links"):
        assert M.extract(f"<article><p>{body}</p><div class='{name}'><p>More of it.</p></div></article>") == body, name


def test_headers_and_references():
    body = "The treatment was well borne by most, though some of them, as ever, were not sure of it."
    assert M.extract(f"<article><header><h1>T</h1>By A. Writer</header><p>{body}</p></article>") == body
    title = "On the slow growth of things that nobody had looked at"
    refs = "".join(f"<li><a href='/{k}'>{title} {k}</a></li>" for k in range(3))
    assert M.extract(f"<article><p>{body}</p><ul>{refs}</ul></article>") == f"{body} {title} 0 {title} 1 {title} 2"
    menu = "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(5))
    assert M.extract(f"<article><p>{body}</p><ul>{menu}</ul></article>") == body


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "deep text, and some more of it here" + "</div>" * 50_000, "<span>" * 20_000 + "<p>x" * 20_000, "<b>" * 30_000 + "</i>" * 30_000 + "tail", "<ul><li>" * 20_000 + "item", "<p a='" * 30_000])
def test_deep_pages_take_linear_time(page):
    import time

    begin = time.perf_counter()
    M.extract(page)
    assert time.perf_counter() - begin < 5
