"""Main text against a plain reading of the article element, and pages of other builds."""

from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matforge.llm import main_text
from matforge.llm import queries as llm

LONG = "It took the town council three long meetings to agree on what the new bridge across the river should look like, and who would pay for it in the end."
MORE = "Work is to begin in spring, once the ice is gone, and the engineers expect that it will last until the autumn of the following year, weather permitting."


class Article(HTMLParser):
    """Text of the article element, cut at the tags that the synthetic pages use for blocks."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " " * self.inside

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(page):
    reader = Article()
    reader.feed(page or "")
    reader.close()
    return "\n".join(b for b in (" ".join(b.split()) for b in reader.blocks) if b)


def read(spark, pages):
    rows = spark.createDataFrame([(i, f"u{i}", p, "t", 1, "b") for i, p in enumerate(pages)], "page_id long, url string, html string, text string, words int, blocks string")
    got = main_text.main_text(rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = {r["page_id"]: r["text"] for r in got.collect()}
    return [out[i] for i in range(len(pages))]


def test_all_pages(spark, small):
    pages = {r["page_id"]: (r["url"], plain(r["html"])) for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = llm.op12_main_text(spark, small).collect()
    assert len(got) == len(pages) and all((r["url"], r["text"]) == pages[r["page_id"]] for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_marked_pages(spark):
    comments = f"<section id='comments'><h3>2 comments</h3><article class='comment'><p>{LONG}</p></article><p>Me too.</p></section>"
    pages = [
        f"<body class='page has-sidebar'><header><h1>The Daily</h1><p>{LONG}</p></header><nav><a href=/>Home</a></nav><div class='cookie-notice'><p>{LONG}</p></div>"
        f"<main><article><header><h1>A bridge</h1></header><p>Short.</p><p>{LONG}<br>{MORE}</p><aside><p>{MORE}</p></aside><div class='ad-slot'>Buy now! {MORE}</div><ul><li>One</li><li>Two &amp; three</ul>"
        f"<form>Your mail <input> <button>Send {LONG}</button></form><footer>Tags: bridge</footer></article>{comments}</main><aside class=sidebar><p>{MORE}</p></aside><footer><p>{LONG}</p></footer>",
        f"<div id='menu'><a>Home</a> <a>News</a></div><div class='entry-content'><div class='entry-header'><h2>A&nbsp;bridge</h2></div><p>{LONG}</p><p>{MORE}</p><p style='display: none'>{LONG}</p></div><div class='commentList'><div>{LONG}</div></div><div class=copyright>All rights reserved</div>",
        f"<article><p>{LONG}</p><script>if (a < b) document.write('<p>{MORE}</p>')</script><style>p > a {{}}</style><!-- <p>{MORE}</p> --><noscript>{MORE}</noscript><table><tr><td>a<td>b</table><p class='ad'>Buy<p>Tail &#x41;&#66; &lt;b&gt; &amp;am",
        f"<article><h1>x</h1><p><a href='/a>b'>{LONG}</a></p><p>Th<b>is</b>  is\n\tone<i> block</i></p></article>",
        f"<div role='navigation'>{LONG}</div><div role=main><p>{LONG}</p></div><div role='complementary'>{MORE}</div>",
    ]
    assert read(spark, pages) == [
        f"A bridge\nShort.\n{LONG} {MORE}\nOne\nTwo & three",
        f"A\u00a0bridge\n{LONG}\n{MORE}",
        f"{LONG}\na\nb\nTail AB <b> &am",
        f"x\n{LONG}\nThis is one block",
        LONG,
    ]


def test_pages_without_marks(spark):
    menu = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in ("Home", "News", "Sport", "About us"))
    page = f"<html><title>T</title><body>{menu}<h1>The bridge is agreed on at last</h1><div>{LONG}</div><div>{MORE} <a href=/x>See here</a></div><div>{LONG}</div><div><a href=/1>Next story</a></div><div><a href=/2>Last story</a></div><div>\u00a9 2024</div>"
    assert read(spark, [page]) == [f"The bridge is agreed on at last\n{LONG}\n{MORE} See here\n{LONG}"]


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + LONG + "</section>" * 20_000
    pages = [None, "", "   ", "<", "<<<>>>", "<nav><a>Home</a></nav>", "<!-- open", "<article>" + "word " * 200_000, deep, "<article><p>\x00 \u0085 x</p>", "<article><a '>" + "y " * 5000]
    got = read(spark, pages)
    assert got[:7] == ["", "", "", got[3], got[4], "", ""] and got[7] == " ".join(["word"] * 200_000) and got[8] == LONG
    assert read(spark, [LONG] * 3) == [LONG] * 3
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    same = spark.createDataFrame([(None, None, f"<article>{LONG}</article>")] * 2, "page_id long, url string, html string")
    assert [tuple(r) for r in main_text.main_text(same).collect()] == [(None, None, LONG, len(LONG))] * 2


def test_tree_fits_its_table(spark):
    tree = main_text.fit_tree(spark)
    split = lambda values: tree_value(tree, values)

    def tree_value(node, values):
        while not isinstance(node, float):
            node = node[2] if values[node[0]] <= node[1] else node[3]
        return node > 0.5

    wrong = total = 0
    for page in main_text.LABELLED:
        for i, (zone, heading, words, linked, keep) in enumerate(page):
            near = [page[j][2:4] if 0 <= j < len(page) else (0, 0) for j in (i - 1, i + 1)]
            values = [words, linked / words, near[0][0], near[0][1] / max(1, near[0][0]), near[1][0], near[1][1] / max(1, near[1][0]), zone, heading]
            wrong += split(values) != bool(keep)
            total += 1
    assert total > 100 and wrong <= 2, "the tree learns its small table"
    assert not isinstance(tree, float)


@given(st.text(alphabet="<>/ap\"'=!-& ;divnbsp", max_size=60))
@settings(max_examples=200, deadline=None)
def test_no_page_breaks_the_reader(page):
    for text, words, linked, zone, heading in main_text.flat_blocks(page):
        assert text and words == len(text.split(" ")) and 0 <= linked <= words


@pytest.mark.parametrize("n", [200_000])
def test_reading_takes_linear_time(n):
    import time

    for page in ("<a '>" * n, "<div " * n, "</p>" * n, "<b><div></section>" * (n // 4), "<!--" * n, "&" * n):
        began = time.time()
        main_text.flat_blocks(page)
        assert time.time() - began < 20
