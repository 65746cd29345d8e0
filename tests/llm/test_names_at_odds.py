"""Names that are at odds with the page do not empty it; pages without names are told by text and structure; any page is read in linear time."""

import os
import re
import time

import pyarrow.parquet as pq
import pytest

from windrow.llm import html_extract

LONG = "A paragraph of the article " + "goes on and on " * 12 + "to its end."
MENU = "<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><form id=aspnetForm>{MENU}<div><h1>Big news</h1><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"Big news\n{LONG}\n{LONG}"),
    (f"<form id=aspnetForm>{MENU}<article><p>{LONG}</p></article></form>", LONG),
    (f"<div class=menu-container>{MENU}<article><h1>Head</h1><p>{LONG}</p></article></div>", f"Head\n{LONG}"),
    (f"<body>{MENU}<article class='alert'><p>{LONG}</p><p>Short.</p></article></body>", f"{LONG}\nShort."),
    (f"<article><h1>Comments</h1><p>{LONG}</p><p>{LONG}</p></article>", f"Comments\n{LONG}\n{LONG}"),
    ("<article><h1>Newsletter</h1><p>Our newsletter now reaches five hundred readers in the whole valley.</p></article>", "Newsletter\nOur newsletter now reaches five hundred readers in the whole valley."),
    (f"<article><p>{LONG}</p><p class='comment'>{LONG}</p><p>{LONG}</p></article>", f"{LONG}\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><section id='search'><p>{LONG}</p></section></article>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><p>Sign up for the newsletter was the slogan of that whole year.</p><p>Gegen ihn wurde Anzeige erstattet.</p></article>", f"{LONG}\nSign up for the newsletter was the slogan of that whole year.\nGegen ihn wurde Anzeige erstattet."),
    # and still out
    (f"<article><p>{LONG}</p><div class='search'>Search this site</div><p>Anzeige</p><p class=comment>Nice one!</p></article>", LONG),
    (f"<body><article><p>{LONG}</p></article><div class=comments>{f'<article class=comment><p>{LONG}</p></article>' * 20}</div></body>", LONG),
    (f"<body><div class=cookie-consent><p>{LONG}</p></div></body>", ""),
    (f"<div hidden><article><p>{LONG}</p></article></div>", ""),
])
def test_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("piece", ["<p a='", "<a b", "<p '>'", "<p a=\"'>", "<!", "<!-", "<b>", "</i>", "<h1>x", "<li>", "<a>", "<div class=nav>", "<div class=search>", "<ul>x", "a < b ", "<p>&", "<b>x<hr>"])
def test_malformed_pages_take_linear_time(piece):
    took = []
    for n in (100_000, 400_000):
        began = time.process_time()
        html_extract.main_text(piece * (n // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_a_malformed_page_of_5_mb():
    began = time.process_time()
    html_extract.main_text("<p a='" * 800_000 + "</p>")
    assert time.process_time() - began < 20


def test_quotes_and_ends_of_tags():
    read = lambda page: [b.text for b in html_extract.read_blocks(page)]
    assert read("<p title='a > b'>x</p>") == ["x"] and read("<p title='a > b>x</p>") == ["b>x"] and read("<p '>'>y</p><p q=\">z") == ["y", "z"]
    assert read("a <3 b<!-- x --!>c<!doctype html>d<? e >f</ >g") == ["a <3 bcdf</ >g"]


DATA = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.isfile(DATA), reason="the driver's tables are not here")
def test_pages_without_names(monkeypatch):
    """The tables' pages with articles as plain divs and without class names: the cut labels more blocks right than their own costs do."""
    right = alone = count = 0
    ran, flow = [], html_extract._flow
    monkeypatch.setattr(html_extract, "_flow", lambda *a: ran.append(1) or flow(*a))
    for page in pq.read_table(DATA).column("html").to_pylist()[:150]:
        truth = {id(b): b.element.article and not b.element.aside for b in html_extract.read_blocks(page)}
        bare = re.sub(r"<(/?)(?:article|nav|footer|aside)\b[^>]*>", r"<\1div>", re.sub(r" class=(?:\"[^\"]*\"|'[^']*'|\w+)", "", page))
        blocks = html_extract.read_blocks(bare)
        assert len(blocks) == len(truth)
        costs, edges = html_extract.page_graph(blocks)
        kept = html_extract.minimum_cut(costs, edges)[: len(blocks)]
        for b, wanted, k, (yes, no) in zip(blocks, truth.values(), kept, costs):
            right, alone, count = right + (k == wanted), alone + ((no > yes) == wanted), count + 1
    print(f"right with the cut {right / count:.4f}, without {alone / count:.4f}, of {count} blocks; the flow ran on {len(ran)} pages")
    assert right > 0.95 * count > alone and len(ran) > 20
