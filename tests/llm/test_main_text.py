"""Main text of pages: the given articles, and pages made for each rule."""

import random
import re
import time
from html import unescape

import pytest

from sqlcorpus.llm import main_text as m, queries

LONG = "This is the text of the article, and it has all the words that a reader of it would look for in such a text."
OTHER = "Dies ist der Text, der auf der Seite steht und den man lesen will, weil er von dem handelt, was man sucht."


def plain(html):
    """What lies in the article, by tags alone; for the given pages, whose markup is known."""
    inside = html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
    parts = (" ".join(unescape(re.sub(r"<[^>]*>?", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(p for p in parts if p)


def test_query_on_given_pages(spark, given):
    found = queries.op12_main_text(spark, given)
    assert found.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    pages = queries.table(spark, given, "pages").collect()
    assert {tuple(r) for r in found.collect()} == {(p["page_id"], p["url"], t := plain(p["html"]), len(t)) for p in pages}


@pytest.mark.parametrize("html, text", [
    (f"<h1>Title</h1><p>{LONG}</p>", f"Title\n{LONG}"),
    (f"<header><h1>Site</h1></header><div id=content><h2>Title</h2><p>{LONG}<p>Short.<p>{OTHER}</div>", f"Title\n{LONG}\nShort.\n{OTHER}"),
    (f"<p>{LONG}</p><p>Short.</p><p>Also <a href=x>a link</a> here.</p><p>{OTHER}</p>", f"{LONG}\nShort.\nAlso a link here.\n{OTHER}"),
    (f"<ul><li><a href=/>Home</a><li><a href=/a>All the news of the day and what is in it for you and for the others</a></ul><p>{LONG}</p>", LONG),
    (f"<div class='cookie-banner'>{OTHER}</div><p>{LONG}</p><section id=comments><h3>Comments</h3><p>{OTHER}</p></section>", LONG),
    (f"<article class='post no-comments'><p>{LONG}</p></article><article class=comment><p>{OTHER}</p></article>", LONG),
    (f"<form id=all><div><article><p>{LONG}</p></article></div><input><p>{OTHER}</p></form>", LONG),
    (f"<form><p>{OTHER}</p></form><p>{LONG}</p><aside>{OTHER}</aside><footer>{OTHER}</footer>", LONG),
    (f"<p>{LONG} <span class=ad>Buy <span>now</span> this</span> More.</p>", f"{LONG} More."),
    (f"<main><p>Kurz.</p><p>Xyz qrs.</p></main><p>{LONG}</p>", "Kurz.\nXyz qrs."),
    (f"<article><header><h1>Title</h1></header><p>A</p><nav><a>Next</a></nav><p>1 &lt; 2 &amp;&nbsp;3 &#x2014; &hellip;</p></article>", "Title\nA\n1 < 2 & 3 — …"),
    (f"<article><p>a\n\t b<br>c<br><br>d</p><pre>e\n f</pre></article>", "a b c\nd\ne f"),
    (f"<head><title>T</title><script>var a='</p><p>';</script><style>p{{}}</style><body><!-- <p>no</p> --><p>{LONG}</p>", LONG),
    (f'<p title="a > b" data-x=\'<p>\'>{LONG}</p>', LONG),
    (f"<div hidden>{OTHER}</div><div style='display: none'>{OTHER}</div><div role=navigation>{OTHER}</div><p>{LONG}</p>", LONG),
    (f"<article><p>1 < 2 and a<b", "1 < 2 and a"),
    ("<article></article>", ""), ("", ""), (None, ""), ("<", ""), ("just words", ""), (f"<p>{LONG}</p><p>© 2024 the owners of the site and all of their friends, who have the rights</p>", LONG),
])
def test_rules(html, text):
    assert m.main_text(html) == text


def test_rows_and_columns(spark):
    page = f"<article><p>{LONG}</p></article>"
    rows = spark.createDataFrame([(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, None, None, None), (2, "v", "", "y", 2)],
                                 "page_id long, url string, html string, text string, `n_chars` int")
    found = sorted((tuple(r) for r in m.extract_text(rows).drop("html").collect()), key=str)
    assert found == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert m.extract_text(rows.where("false")).collect() == []


@pytest.mark.parametrize("piece", ["<div>", "<p>a", "</div>", "<a href=", "<p x=\"", "<!--", "<script>", "&amp", "<br>", "<b>", "<li><ul>", "퟿<", "<h1>"])
def test_time_is_linear_in_long_broken_pages(piece):
    def spent(n):
        at = time.process_time()
        m.main_text(piece * n)
        return time.process_time() - at

    spent(1000)
    assert spent(100_000) < 60 * spent(10_000) + 0.5


def test_any_bytes_are_read():
    rng = random.Random(1)
    pieces = ["<p>", "</p>", "<div class=ad>", "</div>", "<a href='", "'>", "text ", "&lt", "<", ">", "<!--", "-->", "<article>", "</article>", "<script>", "</script", "\0", "é"]
    for _ in range(500):
        m.main_text("".join(rng.choice(pieces) for _ in range(60)))
