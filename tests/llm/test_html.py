from __future__ import annotations

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.html_text import extracted, main_text

LONG = "This paragraph, which is long enough to count, has commas, full stops and the like. It goes on for a while, too."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("body, want", [
    (f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>Foot, with text.</footer>", f"Head\n{LONG}\nShort."),
    (f"<header><h1>Site</h1></header><div class='post'><h2>Head &amp; tail</h2><p>{LONG}<p>Second,\n one.</div><div class='ad'>{LONG}</div><div id=comments><p>{LONG}</div>", f"Head & tail\n{LONG}\nSecond, one."),
    (f"<main><p><b>Bold<br><p>{LONG}</p><aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><section class='reader-comments'><p>x</p></section></main>", f"Bold\n{LONG}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>", f"{LONG}\n{LONG}"),
    (f"<script>var t='<p>{LONG}</p>'</script><div class='cookie-notice'>{LONG}</div><p>A&nbsp;b &lt;c&gt; &#233;.</p>", "A b <c> é."),
    (f"<article><p>{LONG}</p><ul><li>First</li><li>Second</li></ul><blockquote>Said.</blockquote><article class=comment><p>{LONG}</p></article></article>", f"{LONG}\nFirst\nSecond\nSaid."),
    ("", ""), ("<script>x", ""), ("just text, no tags.", "just text, no tags."),
    (f"<article><p>{LONG}</p><div style='display:none'>{LONG}</div><table><tr><td>a<td>b</table></article>", f"{LONG}\na\nb"),
])
def test_cases(body, want):
    assert main_text(page(body)) == want


@given(st.text(alphabet="<>/=\"' ab!-&;p\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_survived(text):
    main_text(text)


def test_query_against_the_pages_own_articles(spark):
    from tessera.llm.queries import op5_html_text

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op5_html_text(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_hard_rows(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", page(f"<p>{LONG}</p>" * 5000)), (4, "u", "\x00<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {(r.page_id, r.url): r.n_chars for r in extracted(pages).collect()}
    assert got[(1, None)] == 0 and got[(1, "u")] == 0 and got[(None, "u")] == 5000 * (len(LONG) + 1) - 1 and len(got) == 4
    assert extracted(pages.limit(0)).count() == 0
