"""Nothing within an aside is content, however long it is and whatever stands around it."""

import pytest

from windrow.llm import html_extract

LONG = "A paragraph of the article " + "goes on and on " * 12 + "to its end."


def said(n):
    return " ".join(f"word{i}" for i in range(n))


@pytest.mark.parametrize("n", [10, 16, 23, 30, 45, 60])
@pytest.mark.parametrize("aside", [
    '<div class="ad">{}</div>', '<div class="notice"><p>{}</p></div>', "<aside><p>{}</p></aside>", "<form><p>{}</p></form>", '<p class="promo">{}</p>', '<div class="newsletter"><h2>{0}</h2><h2>{0}</h2></div>',
    '<div class="ad">{0}<br>{0}<p>{0}</p>{0}</div>',
])
def test_asides_within_an_article(n, aside):
    inside = aside.format(said(n))
    assert html_extract.main_text(f"<article><p>{LONG}</p>{inside}<p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert html_extract.main_text(f"<article><h1>Head</h1><p>{LONG}</p>{inside}{inside}<p>{LONG}</p>{inside}<p>Short.</p></article>") == f"Head\n{LONG}\n{LONG}\nShort."


@pytest.mark.parametrize("n", [10, 26, 60])
@pytest.mark.parametrize("count", [1, 2, 5])
def test_comments_at_the_end_of_an_article(n, count):
    comments = f'<div class="comment">{said(n)}</div>' * count
    assert html_extract.main_text(f"<article><p>{LONG}</p><p>{LONG}</p>{comments}</article>") == f"{LONG}\n{LONG}"


def test_the_cost_of_an_aside_outweighs_all_else():
    """The dearest page there can be: long blocks with edges of the greatest weight around an aside of many."""
    page = f'<article><p>{LONG}</p><div class="ad">{f"<h2>{said(60)}</h2>" * 300}</div><p>{LONG}</p></article>'
    blocks = html_extract.read_blocks(page)
    costs, edges = html_extract.page_graph(blocks)
    aside = {k for k, b in enumerate(blocks) if b.element.aside}
    assert len(aside) == 300 and all(costs[k][0] > sum(c[1] for c in costs[: len(blocks)]) for k in aside)
    assert not any(i in aside or j in aside for i, j, _ in edges)


FOOT = "<div>Contact us</div><div><a href=a>Home page</a> <a href=b>All posts</a></div><div><p>© 2024 Acme. All rights reserved.</p></div>"
COOKIES = "<p>We use cookies on this site. Accept all cookies.</p>"


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div><h1>Big news</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>{FOOT}</body>", f"Big news\n{LONG}\nYes.\n{LONG}"),
    (f"<body><p>{LONG}</p><p>Short one.</p>{COOKIES}<p>Subscribe to our newsletter today!</p><p>{LONG}</p></body>", f"{LONG}\nShort one.\n{LONG}"),
    (f"<body><h1>Title of it</h1><p>{LONG}</p><ul><li>first item<li>second item</ul><p>{LONG}</p></body>", f"Title of it\n{LONG}\nfirst item\nsecond item\n{LONG}"),
    (f"<article><p>{LONG}</p>{COOKIES}<h2>3 Comments</h2><div>Bob: {said(30)}.</div><p>{said(60)}.</p></article>", LONG),
    (f"<article><p>{LONG}</p><h2>Related work</h2><p class='related-work'>{LONG}</p><p class='search-results'>Found.</p></article>", f"{LONG}\nRelated work\n{LONG}\nFound."),
    (f"<article><section><p>{LONG}</p><h3>Comments (2)</h3><p>{said(40)}.</p></section><p>The end.</p></article>", f"{LONG}\nThe end."),
    ("<article><div><div>" + "<p>One.</p>" * 40 + "</div></div></article>", "\n".join(["One."] * 40)),
    ("<script src=https://x.com/>var a=1</script><p>Area is <math><mi>a</mi>+<mi>b</mi></math> here.</p>", "Area is a+b here."),
    (f"<article><p>{LONG}</p><svg><text>no</text></svg><p>More</p><svg viewBox='0'/><p>text.</p></article>", f"{LONG}\nMore\ntext."),
])
def test_pages_told_by_text_and_structure(page, text):
    assert html_extract.main_text(page) == text


def test_the_cut_decides():
    """By their own costs the short lines of an article and of a plain page would go; the cut keeps them."""
    for page in (f"<article><p>{LONG}</p><p>Sh is</p><p>{LONG}</p></article>", f"<body><p>{LONG}</p><p>Sh is</p><p>{LONG}</p></body>"):
        blocks = html_extract.read_blocks(page)
        costs, edges = html_extract.page_graph(blocks)
        assert [no > yes for yes, no in costs[:3]] == [True, False, True]
        assert html_extract.minimum_cut(costs, edges)[:3] == [True, True, True]
        assert html_extract.minimum_cut(costs[:3], [])[1] is False


def test_the_flow_runs_where_no_node_outweighs_its_edges(monkeypatch):
    ran = []
    flow = html_extract._flow
    monkeypatch.setattr(html_extract, "_flow", lambda *a: ran.append(1) or flow(*a))
    text = html_extract.main_text(f"<body><div><p>{LONG}</p></div><div><p>Some six words of plain text</p><p>and</p></div><div><a href=x>Home</a> and more <a href=y>of the links there are</a></div></body>")
    assert ran and text.startswith(LONG)
