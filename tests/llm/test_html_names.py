"""Class names are evidence: article wrappers of common theme classes, pages without article elements, blocks under the body."""

import re

import pytest
from granary.llm import html_text

W = html_text.DEFAULT_WEIGHTS
BODY = "<p>Short intro.</p>" + "".join(f"<p>{'word ' * 40}number {i}.</p>" for i in range(3)) + "<p>Short end of article.</p>"
WHOLE = "Short intro. " + " ".join(f"{'word ' * 40}number {i}." for i in range(3)) + " Short end of article."


def page(wrapper, inside=""):
    return f"<html><body><div class=nav><a href=x>Home</a> <a>About</a></div>{wrapper}{BODY}{inside}</div><div class='sidebar widget'>Side text here</div><footer>Foot</footer></body></html>"


@pytest.mark.parametrize("name", ["story", "content no-sidebar", "site has-sidebar", "post search-post", "post-shareable share-enabled", "ads-free", "entry comment-status-open", "related-story", "noSidebar main"])
def test_the_wrapper_of_an_article_stays_whatever_its_class(name):
    assert html_text.main_text(page(f'<div class="{name}">'), W) == WHOLE
    assert html_text.main_text(page(f"<div id='{name}'>"), W) == WHOLE


@pytest.mark.parametrize("part", ["<div class=ad>Buy this now please</div>", "<div class='ad-slot-top'>Buy this now please</div>", "<aside>More</aside>", "<div class='cookie-notice'>We use them</div>", "<div id=newsletterSignup>Your mail</div>"])
def test_named_parts_of_an_article_go(part):
    assert html_text.main_text(page("<div class=story>", part), W) == WHOLE


def test_threads_and_adverts_may_be_longer_than_the_article():
    thread = "<section class=comments>" + "<p>nice comment text indeed here</p>" * 200 + "</section>"
    assert html_text.main_text(f"<html><body><div class=story>{BODY}</div>{thread}</body></html>", W) == WHOLE
    advert = "<div class=ad>" + "buy this thing " * 30 + "</div>"
    assert html_text.main_text(f"<html><body>{advert}<article><h1>Two words</h1><p>Three more words</article></body></html>", W) == "Two words Three more words"


def test_blocks_beside_the_best_run_under_the_body_stay():
    links = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    got = html_text.main_text(f"<html><body>{links}<h1>Title</h1>{BODY}<p><a href=x>next</a></p><p>After the links.</p></body></html>", W)
    assert got == f"Title {WHOLE}"
    assert html_text.main_text(f"{BODY}", W) == WHOLE


def test_pages_without_article_elements_give_the_same_texts(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    weights = html_text.fit_weights(pages)
    plain = [re.sub(r"<(/?)(?:article|main)\b([^>]*)>", r"<\1div\2>", p) if p else p for p in pages]
    texts = [html_text.main_text(p, weights) for p in pages]
    assert texts == [html_text.main_text(p, weights) for p in plain] and sum(map(bool, texts)) > 200
