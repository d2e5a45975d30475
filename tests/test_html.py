from __future__ import annotations

import html as stdlib_html

import pytest
from helpers import evaluate
from pyspark.sql import functions as F

from newsloom.functions import html, text
from newsloom.operators import extraction


def test_entities_as_the_standard_library_decodes_them(spark):
    cases = [
        "a &amp; b", "&lt;b&gt; &quot;x&quot; &apos;y&apos;", "&copy;&middot;&nbsp;&euro;", "&#65;&#x41;&#8364;&#128512;",
        "&amp;lt;", "&amp;#38;", "&unknown;", "no reference", "&&amp;&", "&eacute;t&Eacute;", "&#38;lt;",
    ]
    assert evaluate(spark, cases, html.decode_entities) == [stdlib_html.unescape(c) for c in cases]


def test_scripts_comments_and_furniture_are_removed(spark):
    page = '<head><title>t</title></head><SCRIPT>var t="</p>";</SCRIPT ><nav>n</nav><p>x<!-- <p>y</p> --></p><header>h</header>'
    assert evaluate(spark, [page], html.clean_html) == ["<head><title>t</title></head><p>x<!-- <p>y</p> --></p>"]
    assert evaluate(spark, [page], html.remove_code) == [
        "<head><title>t</title></head><nav>n</nav><p>x</p><header>h</header>"
    ]


def test_text_of_a_page(spark):
    got = evaluate(spark, ["<p>One <b>two</b></p>\n<p>&amp; three</p>"], lambda c: text.clean_text(html.text_nodes(c)))
    assert got == ["One \ntwo\n& three"]


def test_title_and_language(spark):
    page = '<HTML class="x" lang="de-AT"><head><title data-x="1"> A &amp; B\n</title>'
    assert evaluate(spark, [page], html.title) == ["A & B"]
    assert evaluate(spark, [page, "<html><p lang='fr'>"], html.declared_language) == ["de", ""]


@pytest.mark.parametrize("width,height,kept", [(50, 200, False), (100, 200, False), (101, 101, True), (200, 100, False)])
def test_image_size_is_strict(spark, width, height, kept):
    page = f"<img width='{width}' height={height} src=\"a.png\"><img width=500 height=500>"
    assert evaluate(spark, [page], html.large_images) == [["a.png"] if kept else []]
    assert evaluate(spark, [page], html.images) == [["a.png"]]


METAS = [
    '<meta property="article:published_time" content="A">',
    '<meta content="B" name="publication_date">',
    "<meta name='date' content='C'>",
    '<meta name="pubdate" content="D"/>',
    '<time>x</time><time datetime="E">y</time>',
]


@pytest.mark.parametrize("first", range(5))
def test_publication_date_order(spark, first):
    page = "<head>" + "".join(reversed(METAS[first:])) + "</head>"
    assert evaluate(spark, [page, METAS[first]], html.publication_date) == ["ABCDE"[first]] * 2


def test_no_publication_date(spark):
    pages = ["<p>2024-01-01</p>", '<meta name="date" content="">', '<!-- <meta name="date" content="X"> -->']
    assert evaluate(spark, pages, html.publication_date) == [None] * 3


LOGOS = [
    '<link rel="icon" href="A">',
    '<link href="B" rel="shortcut icon">',
    '<link rel="apple-touch-icon" href="C">',
    '<meta property="og:image" content="D">',
    '<meta name="twitter:image" content="E">',
]


@pytest.mark.parametrize("first", range(5))
def test_logo_order(spark, first):
    assert evaluate(spark, ["".join(reversed(LOGOS[first:])), LOGOS[first]], html.logo) == ["ABCDE"[first]] * 2


SELECTED = [
    ("<body><div class='content'>no</div><article>yes<article>inner</article> end</article></body>", "yes\ninner\nend"),
    ('<body><div role="article">yes</div></body>', "yes"),
    ('<body><div class="x post-content">a<div>b</div>c</div>d</body>', "a\nb\nc"),
    ("<body><section class=article-content>yes</section>no</body>", "yes"),
    ('<body><div class="entry-content">yes</div>no</body>', "yes"),
    ('<body><div class="content">yes</div><div class="my-content">no</div></body>', "yes"),
    ("<body><main>yes</main>no</body>", "yes"),
    ("<body>all <b>of</b> it</body>", "all of it"),
    ("<body><main>never closed<p>end", "never closed\nend"),
]


def test_content_selectors(spark):
    got = evaluate(spark, [page for page, _ in SELECTED], extraction.selected_text)
    assert got == [want for _, want in SELECTED]


def test_text_blocks_skip_headings_and_link_lists(spark):
    page = (
        "<html><head><title>A title long enough to be a block</title></head><body><nav><p>navigation text long enough</p></nav>"
        "<h1>A heading long enough to be a block</h1><p>This paragraph is long &amp; kept.</p><p>Too short.</p>"
        "<p><a href='/x'>A paragraph that is only a link somewhere else</a></p><p>Last <i>paragraph</i><br>of this little page.</p>"
    )
    got = evaluate(spark, [page], extraction.density_text)
    assert got == ["This paragraph is long & kept.\n\nToo short.\n\nLast paragraph of this little page."]


def test_cascade_and_fields(spark):
    body = "<article><p>A paragraph that is long enough to count.</p><img src='i.png' width=200 height=200></article>"
    pages = [
        (1, "http://a.com/x/y", f"<html lang=fr><head>{METAS[0]}</head><body>{body}</body></html>"),
        (2, "http://a.com/z", "<html lang=fr><body><article><h1>Short.</h1><img src='/s.png'></article></body></html>"),
        (3, "http://www.b.com/", '<script>var t="<p>text</p>";</script>'),
    ]
    rows = extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: r for r in rows}
    assert [got[i]["strategy"] for i in (1, 2, 3)] == ["paragraph_density", "tag_strip", None]
    assert got[1]["content"] == "A paragraph that is long enough to count."
    assert (got[1]["language"], got[1]["publication_date"], got[1]["image_urls"]) == ("fr", "A", ["http://a.com/x/i.png"])
    assert (got[2]["content"], got[2]["language"], got[2]["image_urls"]) == ("Short.", None, ["http://a.com/s.png"])
    assert got[3]["content"] is None and got[3]["source_domain"] == "b.com"


def test_filters_read_a_page_once(spark):
    """A filter on an extracted field must not put a second copy of the extraction below it."""
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>x</p>")], "page_id long, url string, html string")
    df = extraction.extract(pages).filter(F.col("content").isNotNull()).select("content")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter isnotnull(content") == 1 and plan.count("tag_strip") == 1


def test_short_paragraphs_stay(spark):
    page = "<body><p>He agreed.</p><p>A long paragraph that stands between two short ones.</p><p>No one died.</p></body>"
    got = evaluate(spark, [page], extraction.density_text)
    assert got == ["He agreed.\n\nA long paragraph that stands between two short ones.\n\nNo one died."]


def test_names_of_custom_elements_are_not_cut(spark):
    page = "<body><nav-bar>x</nav-bar><p>First words.</p><nav>menu</nav><p>Second words.</p></body>"
    assert evaluate(spark, [page], html.clean_html) == [page.replace("<nav>menu</nav>", "")]
    assert evaluate(spark, [page], extraction.density_text)[0].endswith("First words.\n\nSecond words.")


def test_nested_furniture(spark):
    pages = [
        "a<aside>b<aside>c</aside>left over</aside>d",
        "a<aside>never closed <b>x</b>",
        "<aside>1</aside>2<aside>3</aside>4</aside>5",
        "<ASIDE class='x>y'>q<aside/>r</aside></ASIDE >z",
    ]
    got = evaluate(spark, pages, lambda c: html.remove_elements(c, ["aside"]))
    assert got == ["ad", pages[1], "24</aside>5", "z"]


def test_quoted_ends_of_tags(spark):
    page = """<body><p title="a > b">Text <img alt="a > b" src="/kept.png"> of it</p></body>"""
    assert evaluate(spark, [page], html.images) == [["/kept.png"]]
    assert evaluate(spark, [page], extraction.density_text) == ["Text of it"]


def test_title_and_language_outside_comments(spark):
    page = "<!-- <html lang=de><title>Old</title> --><html lang='fil'><title>New</title>"
    assert evaluate(spark, [page], html.title) == ["New"]
    codes = [page, "<html lang=eng>", "<html lang='pt-BR'>", "<html lang=english>", "<html>"]
    assert evaluate(spark, codes, html.declared_language) == ["fil", "en", "pt", "", ""]


def test_structured_dates_come_after_the_others(spark):
    json_ld = '<script type="application/ld+json">{"@graph": [{"datePublished": "2024-05-01"}]}</script>'
    item = '<span itemprop="datePublished" content="2024-05-02">x</span>'
    pages = [
        "<time datetime='2024-05-03'></time>" + json_ld, item + json_ld, item, "<time itemprop=datePublished datetime=2024-05-04>",
        '<script>{"datePublished": "2024-05-05"}</script>', "<p>datePublished</p>",
    ]
    got = evaluate(spark, pages, html.publication_date)
    assert got == ["2024-05-03", "2024-05-01", "2024-05-02", "2024-05-04", None, None]


def test_date_in_the_path_is_the_last_resort(spark):
    text = "<body><p>Some words of an article.</p>"
    rows = [
        (1, "http://a.com/2024/6/01/story", text),
        (2, "http://a.com/2024/06/01/", "<meta name=date content=2023-01-01>" + text),
        (3, "http://a.com/1234/56/78?x=/2024/06/01/", text),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["publication_date"] for r in extraction.extract(pages).collect()}
    assert got == {1: "2024-06-01", 2: "2023-01-01", 3: None}


@pytest.mark.parametrize("quote", ["'", '"'])
def test_a_quote_that_opens_no_value_swallows_nothing(spark, quote):
    page = f"<p title=it{quote}s>One two three.</p><p>Middle words here.</p><p title=it{quote}s>Four five six.</p>"
    lines = ["One two three.", "Middle words here.", "Four five six."]
    assert evaluate(spark, [page], html.text_blocks) == [lines]
    assert evaluate(spark, [page], html.text_nodes)[0].split() == " ".join(lines).split()
    loose = f"<p {quote} data-x = {quote}a > b{quote} class=c{quote}>Kept</p><p x={quote}>Open</p>"
    assert evaluate(spark, [loose], html.text_blocks) == [["Kept", "Open"]]


def test_nested_and_open_elements_are_followed(spark):
    pages = [
        "a<nav>b<nav>c</nav>d</nav>e<nav>f</nav>g",
        "a<nav>b<nav>c</nav>d",
        "a<nav class='x>y'>b</nav >c</nav>d<navigation>e</navigation>",
        "a<NAV\n>b</Nav>c<nav/>d</nav>e",
    ]
    assert evaluate(spark, pages, lambda c: html.remove_elements(c, ["nav"])) == [
        "aeg", "a<nav>b<nav>c</nav>d", "ac</nav>d<navigation>e</navigation>", "ace",
    ]


def test_cleaning_keeps_plans_small(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "html string").select(extraction.density_text(F.col("html")).alias("t"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 25_000
