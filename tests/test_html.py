"""Pages as tokens, against the standard library's own walk."""

import random
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidewire.plans import landed
from tidewire.sources import html, payloads


class Walk(HTMLParser):
    """Title, links and text of a page by callbacks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.texts, self.titles, self.inside = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = next((v for k, v in attrs if k == "href"), None)
            if href and href.strip():
                self.links.append(href.strip(" "))
        if tag in html.RAW:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if "title" in self.inside:
            self.titles.append(data)
        elif not self.inside:
            self.texts.append(data)


def walked(page):
    w = Walk()
    w.feed(page)
    w.close()
    single = lambda x: " ".join(x.split())
    return single("".join(w.titles)) or None, w.links, single(" ".join(w.texts))


def test_given_pages_equal_the_standard_walk(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    rows = html.page_parts(pages).collect()
    assert len(rows) == len(sources)
    for r in rows:
        assert (r.title, r.links, r.text) == walked(sources[r.page_id]), r.page_id
    assert landed.page_parts(spark, "/root/testdata/sf0.001").count() == len(sources)


def test_made_pages_equal_the_standard_walk(spark):
    rng = random.Random(4)
    pieces = ["<p>", "</p>", "<b class='x > y'>", "</b>", '<a href="/a?x=1&amp;y=2">', "<A HREF='/b'>", "<a href=/c>", "</a>", "<a>", "<!-- <a href='/no'> -->", "<!---->", "<br/>", "one", " two &amp; three ", "é&#233;", "<script>var a = '<a href=\"/no\">';</script>", "<style>b>a{}</style>", "<!DOCTYPE html>", "<img src='i.png' alt='a>b'>", "1 < 2", "\n", "<title>T &amp; t</title>", "<textarea><b></textarea>"]
    pages = ["<html>" + "".join(rng.choice(pieces) for _ in range(rng.randrange(25))) + "</html>" for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    for r in html.page_parts(frame).collect():
        title, links, text = walked(pages[r.page_id])
        assert (r.links, r.text) == (links, text), pages[r.page_id]
        assert (r.title is None) == (title is None)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("a < b", [("text", "", "a < b")]),
        ("<p", []),
        ("x<a href='", [("text", "", "x")]),
        ("<!-- open", [("comment", "", " open")]),
        ("<!-->x", [("comment", "", ""), ("text", "", "x")]),
        ("<SCRIPT>a</scripty></Script >b", [("start", "script", ""), ("raw", "script", "a</scripty>"), ("end", "script", ""), ("text", "", "b")]),
        ("<title>a &lt;b></title>", [("start", "title", ""), ("raw", "title", "a <b>"), ("end", "title", "")]),
        ("<style>open", [("start", "style", ""), ("raw", "style", "open")]),
        ("<?xml x?>&amp;", [("declaration", "", "xml x?"), ("text", "", "&")]),
    ],
)
def test_tokens(spark, page, want):
    frame = spark.createDataFrame([(page,)], "p string").select(html.tokens(F.col("p")).alias("t"))
    assert [(t.kind, t.name, t.text) for t in frame.first().t] == want


def test_attributes(spark):
    page = """<img SRC="a&amp;b.png" alt='x > y' data-n=1 checked src=again width = "5">"""
    (token,) = spark.createDataFrame([(page,)], "p string").select(html.tokens(F.col("p")).alias("t")).first().t
    assert token.attributes == {"src": "a&b.png", "alt": "x > y", "data-n": "1", "checked": "", "width": "5"}


def test_hostile_pages_are_walked_once():
    for page in ("<" * 300_000, "<a " * 100_000, "<a href='" * 50_000, "<!--" * 100_000, "<script>" + "</scrip" * 100_000, "&" * 300_000, "<p " + "x='y' " * 100_000 + ">"):
        assert sum(1 for _ in html.tokens_of(page)) < 400_000


def test_rows_of_the_named_table_only(spark):
    page = "<table><tr><td>1</td><td><a href='/no'>No</a></td></tr></table><table id='news-table'><tr><td>Jan-09-26 08:00PM</td><td><a href='/n'>O<b>n</b>e</a><span>(A)</span></td></tr><tr><td>x</td></tr><tr><td>07:00PM</td><td><a>no link</a></td></tr></table><table><tr><td>1</td><td><a href='/no'>No</a></td></tr></table>"
    rows = html.quote_table(spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "payload_id int, payload string"), landed.AS_OF).collect()
    assert [(r.payload_id, r.url, r.title, r.source) for r in rows] == [(1, "https://finviz.com/n", "O n e", "A")]


def test_xml_that_is_none_gives_no_rows(spark):
    rows = spark.createDataFrame([(1, "nonsense"), (2, None), (3, ""), (4, "<rss><channel/></rss>"), (5, "<rss><channel><item><title>A<b>c</b></title><link>https://e.com/1</link></item>")], "payload_id int, payload string")
    assert payloads.rss_items(rows).count() == 0
    assert payloads.filings(rows, F.lit("x")).count() == 0


def test_pages_go_share_by_share(spark, monkeypatch):
    """Neither a large batch of pages nor one long page is held as tokens at once."""
    pages = pa.array(["<p>a</p>" * 500, None, "", "<i>b</i>"] * 25)
    monkeypatch.setattr(html, "MOST_CHARS", 10_000)
    got = list(html.shares(pages))
    assert max(sum(len(p.as_py() or "") for p in x) for x in got) <= 10_000 and pa.concat_arrays(got).equals(pages)
    assert [len(x) for x in html.shares(pa.array([], pa.string()))] == [0]
    rows = spark.createDataFrame([(1, "<p>a</p>" * 2000), (2, None), (3, "x<b>y")], "k long, page string")
    flat = html.token_rows(rows, "k", "page").groupBy("k").agg(F.count("*").alias("n"), F.max("at").alias("last")).orderBy("k")
    assert [tuple(r) for r in flat.collect()] == [(1, 6000, 5999), (3, 3, 2)]
    assert {r.k: len(r.found) for r in html.tokenized(rows, "k", "page").collect()} == {1: 6000, 2: 0, 3: 3}
