"""op12: pages whose main text is known, the reader against another one, and odd pages."""

from __future__ import annotations

import html as references
import random
import re
import time
from html.parser import HTMLParser

import pytest

from scriptorium.llm import catalog, html_text
from tests.llm import fixtures as fx

BODY = (
    "The first paragraph of the story is long enough, has commas, and says what it is about.",
    "The second one, as long, goes on with it, names people, and quotes a few of them.",
    "The third one ends it, with a summary, a date, and an outlook to what comes next.",
)
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)
TEXT = "\n".join(BODY)
AROUND = "<ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>Sport, weather, and more</a></ul>"

CASES = {
    "semantic": (f"<header><h1>Site</h1></header><nav>{AROUND}</nav><main><article><h1>Title</h1>{PARAGRAPHS}<aside><p>Aside, a, b, c</p></aside></article></main><footer>Foot</footer>", f"Title\n{TEXT}"),
    "classes": (f"<div id=header><p>Name, of, the, site</p></div><div class='nav-menu'>{AROUND}</div><div id=content><h1>Title</h1><div class=post-text>{PARAGRAPHS}</div></div><div class=side-bar><div class=sidebar><p>{BODY[0]}</p></div></div><div id=footer>{AROUND}</div>", f"Title\n{TEXT}"),
    "comments outweigh": (f"<article><p>{BODY[0]}</p></article><section id=comments>" + f"<div class=comment><p>{BODY[1]} {BODY[2]}</p></div>" * 9 + "</section>", BODY[0]),
    "comments as articles": (f"<main><article>{PARAGRAPHS}<article class=comment id=comment-3><p>{BODY[0]}</p></article></article></main>", TEXT),
    "tiny article": ("<nav>" + AROUND + f"</nav><div class=ad>{BODY[0]}</div><article><h1>Hi</h1><p>Hi</article><footer>{BODY[1]}</footer>", "Hi\nHi"),
    "empty article": (f"<nav>{AROUND}</nav><div class=ad>{BODY[0]}</div><article></article><footer>{BODY[1]}</footer>", ""),
    "no semantic elements": (f"<body>{PARAGRAPHS}<div class='ad-slot'>Buy</div><script>x('<p>')</script></body>", TEXT),
    "open elements": (f"<article><p><b>{BODY[0]}<br><p>{BODY[1]}<p>{BODY[2]}", TEXT),
    "text of a div": (f"<div class=page><div class=story>{BODY[0]}<br><br>{BODY[1]}</div><div class=cookie-notice>We use cookies, for all, and everything.</div></div>", f"{BODY[0]} {BODY[1]}"),
    "lists, tables, quotes": (f"<article><p>{BODY[0]}</p><ul><li>One</li><li>Two <a href=x>linked</a></li></ul><blockquote><p>Said</p></blockquote><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>", f"{BODY[0]}\nOne\nTwo linked\nSaid\na\nb\nx y"),
    "links in text": (f"<article>{PARAGRAPHS}<p><a href=x>A linked sentence.</a></p>{AROUND}</article>", f"{TEXT}\nA linked sentence."),
    "sections": ("<article>" + "".join(f"<section><h2>{i}</h2><p>{x}</p></section>" for i, x in enumerate(BODY)) + "</article>", "\n".join(f"{i}\n{x}" for i, x in enumerate(BODY))),
    "article header": (f"<article><header><h1>Title</h1><p>By someone</p></header>{PARAGRAPHS}</article>", f"Title\n{TEXT}"),
    "page in a form": (f"<form id=main-form><div><article>{PARAGRAPHS}</article><input name=q></div></form>", TEXT),
    "form in the article": (f"<article>{PARAGRAPHS}<form><label>Mail, please</label><input><button>Go</button></form></article>", TEXT),
    "class of the layout": (f"<div class='page with-sidebar no-comments'><div class=text>{PARAGRAPHS}</div></div>", TEXT),
    "misleading class": (f"<div class=widget><h1>Title</h1>{PARAGRAPHS}</div>", f"Title\n{TEXT}"),
    "hidden": (f"<article>{PARAGRAPHS}<p hidden>Not seen</p><p style='display: none'>Nor this</p></article>", TEXT),
    "references": ("<article><p>a &amp;amp; b &lt;p&gt; caf&eacute;&nbsp;&#x1F600;&copy &am &notit; 1&#50;</article>", "a &amp; b <p> café 😀© &am ¬it; 12"),
    "comments and scripts": ("<article><!-- <p>no</p> --><p>a<!--->b<!-->c<script>if (a<b) '</p>'</script>d<style>p{}</style><!-- open <p>x</p> --!>e</article>", "abcde"),
    "nested script": ("<article><p>a</p><script><!-- <script>x</script> y --></script><p>b</article>", "a\nb"),
    "odd tags": ("<article><P CLASS=\"a>b\" title='<p>'>one</P><p/>two</ p>three<?x y?><!x></article\n>", "one\ntwothree"),
    "svg": (f"<article><svg viewBox='0 0 1 1'><path d=x /><title>no</title></svg><svg/>{PARAGRAPHS}</article>", TEXT),
}


@pytest.mark.parametrize("name", CASES)
def test_op12_known_pages(name):
    page, want = CASES[name]
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>") == want


def test_op12_whole_table(spark):
    """The pages of the table have one article: its heading and paragraphs are the main text."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{fx.SF}/pages.parquet").collect()}
    rows = catalog.QUERIES["op12_html_text"](spark, fx.SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", article)
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        assert r.text == "\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


class Words(HTMLParser):
    """All text outside of scripts and styles, by another reader."""

    def __init__(self):
        super().__init__()
        self.found, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style") and self.off > 0

    def handle_data(self, data):
        if not self.off:
            self.found += data.split()


def test_op12_reader_against_another():
    draw = random.Random(2)
    tags = ["<div>", "</div>", "<p class='x > y'>", "</p>", "<b>", "</b>", "<a href=\"x\">", "</a>", "<li>", "<ul>", "</ul>", "<br/>",
            "<!-- c -->", "<script>var a = '<b>';</script>", "<style>p > a {}</style>", "<td>", "<table>", "</table>"]
    for _ in range(300):
        page = "".join(draw.choice(tags) if draw.random() < 0.6 else f" w{i} " for i in range(draw.randrange(1, 60)))
        other = Words()
        other.feed(page)
        other.close()
        tree = html_text.Tree(page)
        assert "".join(t for _, _, t in tree.texts).split() == other.found
        assert all(p < i for i, p in enumerate(tree.parents))


@pytest.mark.parametrize("part", ["<div>", "<p>x", "<ul><li>a", "<", "<!--", "<a b='", "<a ", "&amp", "<script><!--<script>", "<table><tr><td>",
                                  "<article><div class=ad>", "</b>", "<a href=x>", "<div></span>"])
def test_op12_time_is_linear(part):
    page = part * (400_000 // len(part))
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 8


def test_op12_edges(spark):
    rows = [(1, None, None), (None, "u", "<p>text of a page without an id, with words"), (2, "u", ""), (3, "u", " \n "), (4, "u", "no markup at all, but, some commas"),
            (4, "u", "no markup at all, but, some commas"), (5, "u", "<p>" + "many words, " * 40_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    texts = {None: rows[1][2][3:], 1: "", 2: "", 3: "", 4: rows[4][2], 5: ("many words, " * 40_000).strip()}
    assert got == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    assert html_text.extract(df.limit(0)).count() == 0
