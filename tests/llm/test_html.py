"""The block rules on all pages of the smallest tables, against a walk over the page's tags."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from verdictspark.llm import html_blocks

SKIPPED = ("script", "style", "nav", "aside", "footer", "form", "head", "noscript", "template", "svg")
BREAKS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "blockquote", "table", "tr", "td", "figure", "figcaption", "article", "header", "pre")


class Walker(HTMLParser):
    """The text inside <article>, block by block, without the elements in SKIPPED and classes that name adverts or notices."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.parts, self.blocks = 0, [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS or tag in SKIPPED:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if self.skipped or tag in SKIPPED or re.search(r"\b(ad|advert|cookie|notice|comments?|promo|related|share|sidebar)\b", dict(attrs).get("class") or ""):
            if tag not in ("br", "img", "meta", "link", "input", "hr"):
                self.skipped.append(tag)
        elif tag == "article":
            self.inside += 1

    def handle_endtag(self, tag):
        if tag in BREAKS or tag in SKIPPED:
            self.flush()
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


@pytest.fixture(scope="module")
def pages(sf_dir):
    return [r["html"] or "" for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()]


def test_pages_agree_with_a_walk_over_their_tags(pages):
    for page in pages:
        walker = Walker()
        walker.feed(page)
        walker.close()
        walker.flush()
        assert html_blocks.main_text(page) == "\n".join(walker.blocks)


def test_rules_and_neighbours_decide_what_is_not_set_aside(pages):
    by = Counter()
    for page in pages:
        blocks = html_blocks.blocks_of(page)
        html_blocks.classify(blocks)
        by.update(b.by for b in blocks)
    assert by["rules"] > by["neighbours"] > 0
    assert by["rules"] + by["neighbours"] > 0.9 * (sum(by.values()) - by["region"])


def test_pages_without_article_tags_give_the_same(pages):
    for page in pages:
        assert html_blocks.main_text(re.sub(r"</?article[^>]*>", "", page)) == html_blocks.main_text(page)


def test_blocks_without_tags_to_tell_them():
    """Links and short lines around text in plain <div> elements."""
    long = "This is a paragraph of the text that has enough of the words by which the first pass knows it."
    menu = "".join(f'<div><a href="/{k}">Some place {k}</a></div>' for k in range(5))
    page = f"{menu}<div>{long}</div><div>Short line.</div><div>{long}</div>{menu}<div>{menu}</div>"
    assert html_blocks.main_text(page) == f"{long}\nShort line.\n{long}"
    assert html_blocks.main_text(menu) == ""
    assert html_blocks.main_text("<p>Only this.") == "Only this."
    linked = f'<article><p>{long}</p><p><a href="/x">All of it is a link</a></p><ul><li><a href="/y">Other</a></li></ul></article>'
    assert html_blocks.main_text(linked) == f"{long}\nAll of it is a link"


LINE = "This is a paragraph of the text that has enough of the words by which the first pass knows it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>T</title><style>p</style><body><article><p>{LINE}</p></article>", LINE),
        (f"<html><head><title>T</title><article><p>{LINE}</p></article>", LINE),
        (f"<article><p>{LINE}</p><head-line>Short head</head-line><p>{LINE}</p></article>", f"{LINE}\nShort head\n{LINE}"),
        (f"<article><p>{LINE}</p><select-box>Any</select-box><p>{LINE}</p><script-note>x</script-note></article>", f"{LINE}\nAny\n{LINE}\nx"),
        (f"<article><p>{LINE}</p><div class='by-side'>{LINE} 1</div><p class='search-results'>{LINE} 2</p></article>", f"{LINE}\n{LINE} 1\n{LINE} 2"),
        (f"<article><p>{LINE}</p><div class='notice'>{LINE}</div><p class='share-links'>{LINE}</p><div class='ad'>{LINE}</div></article>", LINE),
        (f'<article><p>{LINE} <a href="foo>bar</a> and more.</p><p>{LINE} said "quoted" now</p></article>', f'{LINE} bar and more.\n{LINE} said "quoted" now'),
        (f"<article><div><p>{LINE}</p><select><option>one</div><p>{LINE}</p></article>", f"{LINE}\n{LINE}"),
        (f"<article><p>a {LINE} <svg><title>no</title><text>no</text></svg> b</p></article>", f"a {LINE} b"),
        (f"<article><div><template><p>{LINE}</div><p>{LINE} 2</p></article>", f"{LINE} 2"),
        (f"<article><p title='a > b' data-x='<i>'>{LINE}</p><p>1 &lt; 2 < 3</p><p>{LINE}<scr", f"{LINE}\n1 < 2 < 3\n{LINE}"),
    ],
)
def test_pages_that_are_not_well_formed(page, text):
    assert html_blocks.main_text(page) == text


def test_broken_tags_take_time_in_proportion():
    for page in ("<svg>" * 20_000, "<div a='" * 30_000 + ">", "<p>" + "<" * 100_000, '<a b="x' * 20_000 + ">", "<template><div>" * 20_000):
        began = time.perf_counter()
        html_blocks.main_text(page)
        assert time.perf_counter() - began < 5
