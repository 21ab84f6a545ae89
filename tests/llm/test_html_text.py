"""Main text of pages: marks that mislead, links and neighbours that decide, and a plain version."""

import html
import re
import time

import pytest

from workweave.llm import html_text
from workweave.llm.html_labels import MAIN, PAGES

TWO = ("<p>One plain paragraph of text stands here for all to read.</p>"
       "<p>And another one of about the same length follows it.</p>")
TEXT = "\n\n".join(re.findall("<p>(.*?)</p>", TWO))


@pytest.fixture(scope="module")
def tree():
    return html_text.trained()


def asked(tree):
    return set() if tree.left is None else {html_text.FEATURES[tree.feature]} | asked(tree.left) | asked(tree.right)


def test_the_tree_asks_links_neighbours_and_marks(tree):
    found = asked(tree)
    assert "links" in found and found & {"mark", "mark_share", "mark_rest"}
    assert found & {"links_before", "links_after"} and found & {"words_before", "words_after"}


def test_labelled_blocks_are_told_apart(tree):
    right = blocks = 0
    for page in PAGES:
        found = html_text.blocks(page)
        if found:
            texts = [b.text for b in found]
            main = tree.main(html_text.features(found, [t.replace(MAIN, "") for t in texts]))
            blocks += len(found)
            right += sum((MAIN in t) == bool(m) for t, m in zip(texts, main, strict=True))
    assert blocks > 1000 and right / blocks > 0.995


@pytest.mark.parametrize("opens", [
    '<div id="page" class="content right-sidebar">', '<article class="post related-work">',
    '<article class="promotion">', '<article class="social-policy">', '<div id="share-price">',
    '<div class="article-with-comments">', '<div class="alerts-free">', '<main class="category-social">',
    "<form>"])
def test_marks_alone_lose_no_article(tree, opens):
    name = opens[1:].split()[0].rstrip(">")
    assert html_text.main_text(f"<html><body>{opens}{TWO}</{name}></body></html>", tree) == TEXT


def test_what_stands_beside_the_article_goes(tree):
    links = "".join(f"<li><a href='{i}'>Link number {i}</a></li>" for i in range(6))
    assert html_text.main_text(f"<body><ul>{links}</ul></body>", tree) == ""
    page = (f"<body><ul>{links}</ul><div class='ad'>Buy three lamps and pay for two of them only</div><article>{TWO}"
            "</article><section class='comments'><article class='comment'><p>I liked this very much and came back."
            "</p></article></section><footer>All rights reserved by us</footer></body>")
    assert html_text.main_text(page, tree) == TEXT


@pytest.mark.parametrize("part", ["<a x", "<b>x ", "<svg ", "<svg>", "<p><b>", "<div class=ad>", "</x>", '<a "',
                                  "<li>", "<a x='\""])
def test_long_pages_take_linear_time(tree, part):
    began = time.time()
    html_text.main_text(part * (1_000_000 // len(part)), tree)
    assert time.time() - began < 15


def plain(page):
    """Main text of the given pages, which all keep it in headings and paragraphs of one article."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", body[1] if body else "")
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", lambda t: " " if "br" in t[0] else "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_given_pages_equal_a_plain_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert found == {r.page_id: (plain(r.html), len(plain(r.html))) for r in pages.collect()}


def test_clashing_columns_nulls_and_repeats(spark):
    page = f"<article>{TWO}</article>"
    rows = [(1, "u", page, "t", 7), (1, "u", page, "t", 7), (None, None, None, None, None), (2, "v", "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert found == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
