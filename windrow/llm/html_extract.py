"""HTML extraction by minimum cut.

A page is read into text blocks and the elements that hold them. Both are nodes of a graph. A classifier
gives each node a cost for either label: a block's comes from its text (how many words, how many of them
linked, whether it ends like a sentence, set phrases of notices, adverts and comment sections), an
element's from its name. These costs are the capacities of the edges from the source and to the sink.
Blocks next to each other, blocks and the element that holds them, and elements and the one around them
are joined by smoothness edges, stronger the closer they stand in the tree. The minimum cut between
source and sink is the cheapest labelling: short lines of an article stay with it, the text of a footer
without a name does not.

What menus, forms, asides and the like hold (by element, role or class) is boilerplate, unless the name is at odds
with the page: an element that holds most of the page's unlinked words and its article or first heading, or a form or
doubtful name with nothing to speak of outside, is a wrapper and its name counts for nothing. Names that may well
stand on a part of an article (`search`, `alert`) are a cost like others, which long running text outweighs.

Before the maximum flow is computed, nodes whose own costs outweigh all their edges are fixed, which
leaves the minimum as it is. Pages are handled one by one within Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.shared import slices

#: Element names and class words by the part they play.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Block elements that hold one piece of text rather than a part of the page.
PIECE = set("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup legend li p pre summary tr".split())
#: Block elements that belong to the running text around them.
FLOW = set("blockquote center dd dir dl fieldset figure hr ol table tbody tfoot thead ul".split())
SPACE = {"br", "td", "th", "wbr"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = set("script style noscript template iframe object svg title textarea select button canvas audio video noframes annotation annotation-xml".split())
ASIDE_TAGS = set("nav footer aside form menu dialog".split())
ARTICLE_WORDS = {"article", "articlebody", "main", "post", "entry", "story", "content"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond newsletter subscribe subscription signup login search pagination pager widget "
    "toolbar copyright disclaimer skip".split()
)
#: Words that may stand beside those of ASIDE_WORDS in a class without changing what it means.
PLAIN_WORDS = ARTICLE_WORDS | set(
    "area articles author bar block body bottom box button buttons child children col column component container count desktop fixed form global google "
    "header icon icons inner item items large left link links list message meta mobile module outer page panel policy posts primary right row secondary "
    "section settings site slot small sticky stories text thread title top tree unit wrap wrapper".split()
)
#: Of these, words that may well name a part of an article, and those that may do so on a single paragraph.
DOUBTFUL_WORDS = set("alert disclaimer login recommended related respond search widget".split())
DOUBTFUL_PIECES = DOUBTFUL_WORDS | {"comment", "reply"}
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond".split())
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "article", "section", "div", "nav", "body"}
#: Set phrases of notices, adverts and calls to act, and of terms, which may close an article as well.
NOTICE = re.compile(
    r"\b(?:uses? cookies|accept (?:all )?cookies|cookie (?:policy|settings|preferences)|newsletter|sign up (?:for|to|now)|subscribe (?:to|now|today)|enter your e-?mail"
    r"|advertisement|sponsored (?:content|post|by)|share (?:this|on)|follow us|log ?in to (?:comment|reply)|leave a (?:comment|reply)|click here"
    r"|verwende[nt] cookies|cookies verwenden|jetzt anmelden|anzeige|utilis(?:e|ons) des cookies|abonnez-vous|publicité"
    r"|(?:utiliza(?:mos)?|usa(?:mos)?) cookies|suscríbe(?:te|ase)|publicidad)\b",
    re.I,
)
TERMS = re.compile(r"\b(?:all rights reserved|privacy policy|terms of (?:use|service)|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\b|^(?:©|copyright\b|\(c\) )", re.I)
#: Headings under which readers' comments or links to other articles follow.
AFTERWORD = re.compile(
    r"(?:\d+\s+|(?:reader|user|your|all|add|post|latest) )*(?:comments?|replies|responses|kommentare?|leserkommentare|commentaires?|comentarios?|related (?:articles|posts|stories|links|news)|read (?:also|more|next)"
    r"|you (?:may|might) also like|more (?:articles|stories|news)|leave a (?:comment|reply)|join the (?:discussion|conversation))(?:\s*[:(].{0,12})?[.:!]?",
    re.I,
)

NAME_OF_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
SPECIAL = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$|["'])""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END = {tag: re.compile(rf"</{tag}\s*/?>", re.I) for tag in UNSHOWN}


def _is_aside(name: str) -> bool:
    """Whether a class or id speaks of something beside the article, and of nothing else (`cookie-notice`, not `related-work`)."""
    words = {w.lower() for w in NAME.findall(name)}
    return bool(words & ASIDE_WORDS) and all(w in ASIDE_WORDS or w in PLAIN_WORDS or len(w) < 3 for w in words)


class _Element:
    """root: the innermost element around this one (or itself) that is named as an aside, None if there is none.

    aside: all in it is boilerplate, as it is hidden or within an aside of a plain name that is no wrapper; known once the page is read.
    outer: the root of the element around a root. kind of a root: 2 for a plain name, 1 for a doubtful one. block, holder and part: the innermost block element, the
    element that holds its text as a part of the page, and that outside of lists, quotations and tables.
    """

    __slots__ = ("tag", "root", "outer", "kind", "comment", "hidden", "article", "own_article", "linked", "number", "last", "parent", "block", "holder", "part", "words", "titled", "lifted", "aside")

    def __init__(self, tag: str, parent: _Element | None, number: int, attributes: str = ""):
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        self.root, self.article, self.linked, self.hidden = (parent.root, parent.article, parent.linked, parent.hidden) if parent else (None, False, False, False)
        self.outer, self.kind, self.comment, self.own_article, self.words, self.titled, self.lifted, self.aside = self.root, 0, False, False, 0, False, False, False
        if tag == "a":
            self.linked = True
        elif tag in ("article", "main"):
            self.article = self.own_article = True
        elif tag in ASIDE_TAGS or tag == "header" and not self.article:
            self.kind = 2
        if attributes.strip(" /"):
            self._attributes(attributes)
        if self.kind:
            self.root = self
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.holder = self if tag not in PIECE or parent is None else parent.holder
        self.part = self if tag not in FLOW or parent is None else parent.part

    def _attributes(self, attributes: str) -> None:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                self.hidden = True
            elif name == "role":
                if value.lower() in ASIDE_ROLES:
                    self.kind = max(self.kind, 1 if value.lower() in DOUBTFUL_WORDS else 2)
                if value.lower() in ("main", "article"):
                    self.article = self.own_article = True
            elif name == "itemprop":
                if value.lower() == "articlebody":
                    self.article = self.own_article = True
            elif name in ("class", "id") and self.tag not in ("html", "body", "main"):
                for part in value.split():
                    words = {w.lower() for w in NAME.findall(part)}
                    if _is_aside(part):
                        found = words & ASIDE_WORDS
                        self.kind = max(self.kind, 1 if found <= (DOUBTFUL_PIECES if self.tag in PIECE else DOUBTFUL_WORDS) else 2)
                        self.comment = self.comment or bool(found & COMMENT_WORDS)
                    elif "header" in words and not self.article and words <= PLAIN_WORDS and not words & ARTICLE_WORDS:
                        self.kind = 2
                    elif words & ARTICLE_WORDS and words <= PLAIN_WORDS:
                        self.article = self.own_article = True

    @property
    def doubtful(self) -> bool:
        return self.root is not None and self.root.kind == 1 and not self.root.lifted


class _Block:
    __slots__ = ("text", "linked", "element", "level", "words")

    def __init__(self, text: str, linked: int, element: _Element):
        self.text, self.linked, self.element = text, linked, element
        self.words = 0 if linked * 2 > len(text) else text.count(" ") + 1  # unlinked ones
        self.level = int(element.tag[1]) if len(element.tag) == 2 and element.tag[0] == "h" and element.tag[1].isdigit() else 0


def read_blocks(page: str) -> list[_Block]:
    """The non-empty text blocks of a page in order, without markup, scripts and other text that is never shown."""
    blocks: list[_Block] = []
    stack = [_Element("", None, 0)]
    elements = [stack[0]]
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(_Block(text, min(linked, len(text)), stack[-1].block))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        for e in stack[depth:]:
            open_[e.tag] -= 1
        del stack[depth:]

    def say(raw: str) -> None:
        nonlocal linked
        if stack[-1].tag == "head":
            if not raw.strip():
                return
            close(len(stack) - 1)
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].linked:
            linked += len(text)

    at, end = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    dead: set[int] = set()  # quotes after which, read from outside of quotes, no tag ends

    def tag_end(start: int) -> int:
        """The end of a tag whose name ends at `start`, -1 if it has none; a `>` in quotes does not end it, unless none outside of quotes does."""
        seen, pos = [], start
        while pos <= last[">"]:
            pos = SPECIAL.search(page, pos).start()
            if page[pos] == ">":
                return pos + 1
            if pos in dead or pos >= last[page[pos]]:
                seen.append(pos)
                break
            seen.append(pos)
            pos = page.find(page[pos], pos + 1) + 1
        dead.update(seen)
        return page.find(">", start) + 1 if start <= last[">"] else -1

    text_from = 0
    while True:
        at = page.find("<", at)
        if at < 0 or at > last[">"]:
            say(page[text_from:]) if text_from < end else None
            break
        if page.startswith("<!--", at):
            over = COMMENT_END.search(page, at + 4)
            after, tag = over.end() if over else end, ""
        elif page[at + 1] in "!?":
            after, tag = page.find(">", at) + 1, ""
        elif (name := NAME_OF_TAG.match(page, at + 1)) and (after := tag_end(name.end())) > 0:
            tag = name.group()
        else:
            at += 1
            continue
        if at > text_from:
            say(page[text_from:at])
        at = text_from = after
        if not tag:
            continue
        attributes = page[name.end() : after - 1]
        closing, tag = tag[0] == "/", tag.lstrip("/")
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
            elif tag in SPACE:
                parts.append(" ")
            for depth in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in UNSHOWN:
            # only foreign elements can close themselves, and not by the slash of an unquoted value
            if tag != "svg" or not re.search(r"(?:^|[\s\"'])/\s*$", attributes):
                found = END[tag].search(page, at)
                at = text_from = found.end() if found else end
            continue
        if tag in SPACE:
            parts.append(" ")
        if tag in BLOCK:
            flush()
            if stack[-1].tag == "head":
                close(len(stack) - 1)
            for depth in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        if tag in CLOSED_BY:
            for depth in range(len(stack) - 1, 0, -1) if any(open_[t] for t in CLOSED_BY[tag]) else ():
                if stack[depth].tag in CLOSED_BY[tag]:
                    close(depth)
                    break
                if stack[depth].tag in SCOPES:
                    break
        if tag == "a":
            for depth in range(len(stack) - 1, 0, -1) if open_["a"] else ():  # links do not nest
                if stack[depth].tag == "a":
                    close(depth)
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag not in VOID:
            stack.append(_Element(tag, stack[-1], len(elements), attributes))
            elements.append(stack[-1])
            open_[tag] += 1
    flush()
    _find_wrappers(elements, blocks)
    return blocks


def _find_wrappers(elements: list[_Element], blocks: list[_Block]) -> None:
    """Mark the asides that are wrappers, and give each element its last descendant's number."""
    total = outside = 0
    for b in blocks:
        if not b.element.hidden:
            total += b.words
            if b.element.root is not None:
                b.element.root.words += b.words
            else:
                outside += b.words
    for e in reversed(elements):  # inner ones first
        if e.parent is not None:
            e.parent.last = max(e.parent.last, e.last)
            e.parent.titled |= e.titled or e.tag == "h1" or e.own_article
        if e.kind and e.outer is not None:
            e.outer.words += e.words
    for e in elements:
        if e.kind and not e.hidden and 2 * e.words > total:
            alone = outside < 8 if e.comment else 10 * outside < e.words
            e.lifted = (e.titled or e.own_article) and (alone or not e.comment) or alone and e.words >= 25 and (e.kind == 1 or e.tag in ("form", "dialog"))
            if e.lifted and e.outer is not None and not e.outer.lifted:
                e.lifted = False
            if e.lifted:
                # what a wrapper holds belongs to what is around it
                e.kind = 0
    for e in elements:
        if e.parent is not None and e.root is not None and e.root.kind == 0:
            e.root = e.parent.root
        e.aside = e.hidden or e.kind == 2 or e.parent is not None and e.parent.aside


#: What an aside's or a hidden block's content would cost, and an article element that is none: more than all other costs of a page together.
NEVER = 10**9
#: Smoothness: between a block and the element that holds it, within an article and elsewhere; between an element and the
#: one around it; between neighbouring blocks of one element and of different ones. Costs are hundredths. Elements within
#: an article belong to it, whatever they hold; a block may still cost too much.
IN_ARTICLE, IN_ELEMENT, OF_ELEMENTS, NEIGHBOURS, ACROSS = 400, 80, 30, 80, 20
#: What a doubtful name costs a block of an element so named, and a single paragraph of that name, which is tied to the article itself.
DOUBTFUL, DOUBTFUL_PIECE = 250, 700
#: Lists, quotations and tables are tied more closely to what surrounds them than parts of the page are.
OF_FLOW = 120


def text_costs(blocks: list[_Block]) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """Cost of calling each block content, cost of calling it boilerplate, by its text and what stands around it; and the same costs of the page's parts by number.

    A block is taken for content by its unlinked words; a short one is hardly taken for anything, but a part
    of the page with a few words only is taken for boilerplate and one with many for content. How many words
    are few is measured against the page's longest block, so that a page of short lines is not boilerplate
    as a whole.
    """
    words = [b.words for b in blocks]
    longest = max((n for b, n in zip(blocks, words) if not b.element.aside), default=0)
    base = min(100, 4 * longest)
    held: dict[int, int] = {}  # unlinked words
    out: list[tuple[int, int]] = []
    after: tuple[_Element, int] | None = None  # the holder and level of the heading of an afterword
    for b, n in zip(blocks, words):
        holder = b.element.holder
        if after is not None and (b.level and b.level <= (after[1] or 6) or not _within(holder, after[0])):
            after = None
        short = b.text.count(" ") < 8
        if short and b.level != 1 and (b.level or b.element.tag == "p" or holder is b.element) and AFTERWORD.fullmatch(b.text):
            after = holder, b.level
        favour = min(300, 12 * n)
        if b.level:
            favour += 50
        elif b.text[-1] in ".!?…:;»”\"'":
            favour += 40
        against = min(base, favour + 5)
        if b.linked * 2 > len(b.text):
            against += 350 * b.linked // len(b.text)
        phrases = 0 if b.level == 1 else sum(len(m.group().split()) for m in NOTICE.finditer(b.text))
        if phrases:
            # the whole of a short notice speaks of it; a sentence that mentions one says more
            against += min(700, 700 * phrases * 5 // (2 * max(n, 1))) if n <= 25 else min(300, 6000 * phrases // n)
        elif TERMS.search(b.text):
            against += 300
        if after is not None:
            against += 1200
        if b.element.doubtful:
            against += DOUBTFUL_PIECE if holder is not b.element.root and not holder.doubtful else DOUBTFUL
        out.append((NEVER if b.element.aside else against, favour))
        part = holder.part
        if not part.article:
            held[part.number] = held.get(part.number, 0) + n + 8 * (b.level > 0)
    whole = {0} | {b.element.number for b in blocks if b.element.tag in ("html", "body")}
    return out, {number: (0, 120) if n >= 25 else (0 if number in whole else base * 60 // 100, 0) for number, n in held.items() if n >= 25 or n < 8}


def _within(element: _Element, outer: _Element) -> bool:
    return outer.number <= element.number <= outer.last


def page_graph(blocks: list[_Block]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """The nodes' costs of True (content) and of False, blocks first, and the edges (i, j, cost of different labels).

    Elements follow the blocks; those of asides are left out, as all their blocks are decided.
    """
    costs, parts = text_costs(blocks)
    edges, node = [], {}

    def number_of(element: _Element) -> int:
        new, at = [], element
        while at is not None and at.number not in node:
            node[at.number] = len(costs)
            costs.append((0, NEVER) if at.article and not (at.parent and at.parent.article) else parts.get(at.number, (0, 0)))
            new.append(at)
            at = at.parent
        for e in new:
            if e.parent is not None:
                edges.append((node[e.number], node[e.parent.number], NEVER if e.parent.article and not e.doubtful else OF_FLOW if e.tag in FLOW else OF_ELEMENTS))
        return node[element.number]

    last: tuple[int, int] | None = None
    for i, b in enumerate(blocks):
        if b.element.aside:
            continue
        holder = b.element.holder
        edges.append((i, number_of(holder), IN_ARTICLE if holder.article and not holder.doubtful else IN_ELEMENT))
        if last is not None:
            edges.append((last[0], i, NEIGHBOURS if last[1] == holder.number else ACROSS))
        last = i, holder.number
    return costs, edges


def minimum_cut(unary: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's (content) side of a minimum cut.

    unary: cost of True and of False for each node; edges: (i, j, cost of giving i and j different labels).
    """
    n = len(unary)
    gain = [no - yes for yes, no in unary]  # over 0: True is cheaper
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    total = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) >= total[i]:
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    total[j] -= w
                    queue.append(j)
    free = [i for i in range(n) if label[i] is None]
    if free:
        for i, side in zip(free, _flow(free, gain, near, label)):
            label[i] = side
    return label


def _flow(free: list[int], gain: list[int], near: list[dict[int, int]], label: list[bool | None]) -> list[bool]:
    """Maximum flow by blocking flows in level graphs; which of the free nodes the source still reaches."""
    index = {node: k for k, node in enumerate(free)}
    s, t = len(free), len(free) + 1
    graph: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for node in free:
        if gain[node] > 0:
            join(s, index[node], gain[node], 0)
        elif gain[node] < 0:
            join(index[node], t, -gain[node], 0)
        for other, w in near[node].items():
            if label[other] is None and other > node:
                join(index[node], index[other], w, w)

    def levels() -> list[int]:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[t] >= 0:
        nxt = [0] * (t + 1)
        path: list[int] = []
        at = s
        while True:
            if at == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                at = to[path[cut] ^ 1]
                del path[cut:]
            elif nxt[at] < len(graph[at]):
                e = graph[at][nxt[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                else:
                    nxt[at] += 1
            elif path:
                at = to[path.pop() ^ 1]
                nxt[at] += 1
            else:
                break
    return [x >= 0 for x in level[:s]]


def main_text(page: str | None) -> str:
    blocks = read_blocks(page or "")
    keep = minimum_cut(*page_graph(blocks))
    return "\n".join(b.text for b, kept in zip(blocks, keep) if kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    A null or empty page gives empty text. Where both labels of a block cost the same it is boilerplate.
    A null page_id or url is kept. Repeated rows come back as often as given, and columns other than these
    are not read. Texts of any length and depth of nesting are read whole, without recursion.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page.as_py()) for page in part.column("html")]
                yield pa.record_batch({
                    "page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                })

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(apply, "page_id long, url string, text string, n_chars long")
