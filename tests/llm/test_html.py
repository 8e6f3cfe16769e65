"""Main text of hand-made pages, and of the given ones against their article element."""

import html as H
import os
import re
import time

import pytest

from rankweave.llm import html
from rankweave.llm.html import extracted, main_text, smoothed

FOLDER = "/root/testdata/sf0.001"
LONG = "This is a long paragraph of the article with quite a few words in it, as articles have them."


@pytest.mark.parametrize("page, text", [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<html><body></body></html>", ""),
    (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy;</footer>",
     f"Title {LONG} Short."),
    (f"<body><header>Site</header><div class='sidebar'>Links</div><main><p>{LONG}<p>A &amp; B&nbsp;C &#8364;</main>",
     f"{LONG} A & B C €"),
    (f"<article><p>{LONG}</p><div class=comments><p>I do not agree with any of this at all!</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><form><label>Mail</label><input></form><p>End<br>of it</p></article>", f"{LONG} End of it"),
    (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=content><p>{LONG}</p><p>{LONG}</p><p>Bye.</p></div>",
     f"{LONG} {LONG} Bye."),
    (f"<article><p>{LONG}</p><script>var a='</p>';</script><style>p{{}}</style><div class='cookie-notice'>OK?</div></article>", LONG),
    (f"<article><p>in<b>line</b> and <i>mark</i>up</p><p>{LONG}</p></article>", f"inline and markup {LONG}"),
    (f"<![bad[ x ]]><article><p>{LONG}</p></article>", LONG),
    (f"<article><header><h1>Own title</h1></header><p>{LONG}</p><footer>Filed</footer></article>", f"Own title {LONG}"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_long_and_broken_pages_end():
    assert main_text("<p>" * 20_000 + "x") == "x"
    assert main_text("<" * 20_000).startswith("<")
    assert main_text("<b>" * 20_000 + "y" + "</i>" * 20_000) == "y"
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>") == " ".join(["word"] * 20_000)


def test_smoothing_keeps_a_constant():
    import numpy as np

    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a", "x"), (1, "u", "", "x")],
                                  "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text) for r in extracted(pages).collect())
    assert got == [(0, None, "a"), (1, "u", ""), (1, "u", "")]
    assert extracted(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(H.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
    assert {r.page_id: r.text for r in extracted(pages).collect()} == want


@pytest.mark.parametrize("page", ["<!--" * 100_000, "<a" * 100_000, "</" * 100_000, "<![CDATA[" * 30_000 + ">",
                                  "<div>" * 60_000, "<b><div>w" * 20_000, "<title>" + "</titl" * 50_000])
def test_hostile_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("page, text", [
    ("<p>one</p><!-- <p>two</p>", "one two"), ("<p>one</p> 1 < 2", "one 1 < 2"),
    ("<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000, "deep"), ("<p>a</p><![CDATA[<p>b</p>", "a CDATA[ b")])
def test_unclosed_and_deep(page, text):
    assert main_text(page) == text


QUOTE = "A quotation that is by far the longest part of its page, and so draws the vote of the ratios. " * 6


@pytest.mark.parametrize("page, text", [
    (f"<div id=content><p>{LONG}</p><blockquote>{QUOTE}</blockquote><p>{LONG}</p></div>", f"{LONG} {QUOTE.strip()} {LONG}"),
    (f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><p>{LONG}</p><div>{QUOTE}</div>"
     f"<table><tr><td>{LONG}</td></tr></table></div>", f"{LONG} {QUOTE.strip()} {LONG}"),
    (f"<div><p>{LONG}</p></div><div><section>{QUOTE}</section></div>", f"{LONG} {QUOTE.strip()}"),
    (f"<div><p>{LONG}</p><p><a href=x>The whole study</a></p><figure>{QUOTE}</figure></div>",
     f"{LONG} The whole study {QUOTE.strip()}")])
def test_without_article_no_clustered_line_is_lost(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<div class='content-sidebar-wrap'><main><p>{LONG}</p></main><div class=sidebar>Links</div></div>", LONG),
    (f"<div id=page class='no-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='post has-comments'><p>{LONG}</p><p>End.</p></div>", f"{LONG} End."),
    (f"<section class='social-issues'><article><p>{LONG}</p></article></section>", LONG),
    (f"<article><p>{LONG}</p><div class='search-results-table'>A 1</div><p class='notice-period'>Two weeks.</p></article>",
     f"{LONG} A 1 Two weeks."),
    (f"<div class=header><div class=widget><p>{LONG}</p></div></div>", LONG),
    (f"<div class=comments><p>{LONG}</p></div>", LONG),
    (f"<div class=layout-sidebar><article><p>{LONG}</p></article></div><p>Contact</p>", LONG)])
def test_a_name_does_not_take_the_article_away(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", [
    f"<div class='comments-area'><article class=comment><p>{QUOTE}</p></article></div>",
    f"<div class='sidebar-left'><p>{LONG}</p></div>", f"<div id=relatedPosts><article><p>{LONG}</p></article></div>",
    f"<section class='site-footer__inner'>{LONG}</section>", f"<div class='ad-slot2'>{LONG}</div>"])
def test_foreign_parts_stay_out(part):
    assert main_text(f"<main><article><p>{LONG}</p></article>{part}</main>") == LONG
    assert main_text(f"<article><p>{LONG}</p></article>{part}") == LONG
    assert main_text(f"<div><p>{LONG} {LONG}</p><p>{LONG}</p></div>" + part.replace("article", "div")) == " ".join([LONG] * 3)


MENU = "<p><a href=1>Politics</a></p><p><a href=2>Sport today</a></p><p><a href=3>Weather</a></p><p><a href=4>Travel</a></p>"


@pytest.mark.parametrize("page, text", [
    (f"<article><p>{LONG}</p><p>{LONG}</p>{MENU}{MENU}</article>", f"{LONG} {LONG}"),
    (f"<article><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><p><a href=1>The whole study</a></p><p>{LONG}</p></article>", f"{LONG} The whole study {LONG}"),
    (f"<article><p>{LONG}</p><ul><li>See <a href=1>one</a> of these places</li><li>Or two</li></ul></article>",
     f"{LONG} See one of these places Or two"),
    (f"<article><p><a href=1>{LONG}</a></p><p><a href=2>{LONG}</a></p></article>", f"{LONG} {LONG}")])
def test_clusters_decide_about_links_in_an_article(page, text):
    assert main_text(page) == text


def test_other_clusters_give_other_articles(monkeypatch):
    page = f"<article><p>{LONG}</p><p>{LONG}</p>{MENU}{MENU}</article>"
    assert main_text(page) == f"{LONG} {LONG}"
    monkeypatch.setattr(html, "clustered", lambda lines: html.np.ones(len(lines), bool))
    assert main_text(page).count("Weather") == 2


@pytest.mark.parametrize("page, text", [
    (f"<form action=x><header>Site</header><article><p>{LONG}</p></article><footer>End</footer></form>", LONG),
    (f"<form><div><p>{LONG}</p><p>{LONG}</p></div><input><label>Mail</label><button>Send</button></form>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><p>{LONG}</p><form><p>Write to us.</p></form></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><p>Press <button>Start</button> and wait.</p><button>Share</button></article>",
     f"{LONG} Press Start and wait."),
    (f"<article><p>{LONG}</p><p>" + "<b><i>" * 6 + "deep</i>er" + "</b></i>" * 6 + " end</p></article>", f"{LONG} deeper end"),
    (f"<article><p>{LONG}</p><span><div>" + "<i>" * 9 + "wo</span>rd</div></article>", f"{LONG} word")])
def test_forms_and_deep_inline_markup(page, text):
    assert main_text(page) == text
