"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A linear classifier gives each block a score (above 0:
content), which is its capacity to the source or the sink. Blocks that follow each other, and
blocks of one parent, are joined by smoothness edges that weaken with their distance in the
DOM. The maximum flow separates content from boilerplate: blocks on the source's side of the
minimum cut are the text.

A block whose score outweighs all its edges has the same label in every minimum cut; such
blocks are decided first and their edges added to the scores of their neighbours, and only
what is then left goes through the flow.

Defined results: null or empty html gives an empty text; character references are decoded,
also without a semicolon where HTML allows it; white space inside a block is one space;
a page without any block gives an empty text; an opaque element without an end tag is skipped alone,
unless it is raw text (script, style, textarea, title), which then holds the rest of the page; rows with equal ids are extracted one by one;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import html as html_entities
import itertools
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch

_ATTRS = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
#: Elements that are skipped with all they hold, if they have an end tag.
OPAQUE = {"script", "style", "noscript", "title", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video",
          "select", "textarea", "button", "datalist"}
#: Those of them whose text is never markup: without an end tag they hold the rest of the page.
RAW_TEXT = {"script", "style", "textarea", "title"}
#: Those of them that a slash at the end of the tag closes.
SELF_CLOSED = {"svg", "math"}
#: Those of them that cannot hold one of their own kind: the next start tag ends them.
UNNESTED = {"button", "select"}
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"
                   rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS}|[^>]*)>|<[!?/][^>]*>", re.S | re.I)
#: A comment or section without an end takes the rest of the page.
UNENDED = re.compile(r"<!--|<!\[CDATA\[", re.I)
END_OF = {tag: re.compile(rf"<{'/?' if tag in UNNESTED else '/'}{tag}(?=[\s/>])[^>]*>", re.I) for tag in OPAQUE}
#: One attribute after the other, so that no name is found inside a value or a longer name.
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'|.""", re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar",
             "alertdialog", "toolbar"}
BAD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
             "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay",
             "newsletter", "subscribe", "subscription", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb",
             "breadcrumbs", "footer", "foot", "masthead", "topbar", "share", "sharing", "social", "related", "recommended",
             "recommendations", "widget", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus",
             "login", "signup", "signin", "register", "search", "copyright", "legal", "pagination", "pager", "toolbar", "alert",
             "disclaimer", "teaser", "trending", "form", "skip"}
#: What follows one of these in a class or id says how the page is laid out, not what the element is.
LAYOUT_WORDS = {"has", "no", "with", "without"}
GOOD_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text", "articlebody"}
#: The only words that turn an article or main element into boilerplate.
BAD_ARTICLES = {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored", "related", "teaser"}
FURNITURE = re.compile(r"(?i)\b(all rights reserved|accept (all )?cookies|we use cookies|privacy policy|terms of (use|service)"
                       r"|subscribe to|sign up for|follow us|share this|skip to content|leave a (comment|reply))\b|©")

BAD, GOOD, OUTER = -8.0, 4.0, 0.25
ADJACENT, SIBLING, REACH = 1.2, 1.0, 3.0


def _name_words(name: str) -> set[str]:
    """The words of a class or id up to the first of :data:`LAYOUT_WORDS`."""
    words = [w.lower() for w in WORDS.findall(name)]
    return set(itertools.takewhile(lambda w: w not in LAYOUT_WORDS, words))


class Node:
    __slots__ = ("tag", "parent", "depth", "hint", "link")

    def __init__(self, tag: str, parent: "Node | None", attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.hint = self._hint(attrs)

    def _hint(self, attrs: str) -> float:
        """What this element alone says of the blocks in it."""
        names: list[set[str]] = []
        role = ""
        if attrs and self.tag not in ("body", "html"):
            for name, value in ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                value = html_entities.unescape(value) if "&" in value else value
                if name == "role":
                    role = value.lower()
                elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    return BAD
                elif name in ("class", "id", "itemprop"):
                    names += map(_name_words, value.split())
        if self.tag in ("article", "main"):
            return BAD if any(w & BAD_ARTICLES for w in names) else GOOD
        if self.tag in BAD_TAGS or role in BAD_ROLES or self.tag == "header" and not self._in_article():
            return BAD
        bad = sum(bool(w & BAD_WORDS) for w in names)
        good = len(set().union(*(w & GOOD_WORDS for w in names if not w & BAD_WORDS)))
        if bad:                        # a name with both, like post-comments, is a bad one
            return max(BAD, min(BAD * bad + GOOD * good, GOOD / 2))
        if self.tag == "header":
            return 0.0
        if good or role in ("main", "article"):
            return GOOD / 2
        return 0.0

    def _in_article(self) -> bool:
        n = self.parent
        while n:
            if n.tag in ("article", "main"):
                return True
            n = n.parent
        return False


def after_opaque(html: str, tag: str, attrs: str, at: int, ends: dict[str, int]) -> int:
    """Where the page goes on after an opaque start tag that ends at ``at``. ``ends`` remembers from where on
    a name has no end tag, so that many start tags without one are not searched to the end each."""
    if tag in SELF_CLOSED and attrs.endswith("/"):
        return at
    end = END_OF[tag].search(html, at) if at < ends.get(tag, len(html)) else None
    if end and end[0][1] == "/":
        return end.end()
    if not end:
        ends[tag] = min(at, ends.get(tag, at))
    return len(html) if tag in RAW_TEXT else at


def blocks(html: str) -> list[tuple[str, Node, float, str]]:
    """(text, parent, share of it in links, innermost tag) of the text blocks in page order."""
    root = Node("html", None, "")
    here, out, own = root, [], []
    place = root

    def flush():
        if own:
            text = " ".join(html_entities.unescape("".join(t for t, _ in own)).split())
            if text:
                total = sum(len(t) for t, _ in own)
                out.append((text, place, sum(len(t) for t, link in own if link) / max(total, 1), place.tag))
            own.clear()

    def add(text: str):
        nonlocal place
        if text:
            if not own:
                if text.isspace():
                    return
                place = here
                while place.parent and place.tag in INLINE:
                    place = place.parent
            own.append((text, here.link))

    at, ends = 0, {}
    last = html.rfind(">") + 1                # no tag ends behind it: what looks like one isn't searched to the end each time
    while m := TOKEN.search(html, at, last):
        add(html[at:m.start()])
        at = m.end()
        if at == last and UNENDED.match(m[0]) and not m[0].endswith(("-->", "]]>")):
            at = len(html)
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in OPAQUE and not m[1]:
            at = after_opaque(html, tag, m[3], at, ends)
            continue
        block = tag not in INLINE
        if tag == "br" or tag == "hr":
            if own:
                own.append((" ", here.link))
            if tag == "br":
                continue
        if block:
            flush()
        if m[1]:
            n = here
            while n.parent and n.tag != tag:
                if not block and n.tag not in INLINE:
                    n = root           # an inline end tag does not close blocks
                    break
                n = n.parent
            if n.parent:
                here = n.parent
        elif tag not in VOID and not m[3].endswith("/"):
            if block:                  # what HTML closes by itself
                closes = {"p", *HEADINGS} if tag not in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p", tag}
                n = here
                while n.parent and n.tag in INLINE:
                    n = n.parent
                if n.parent and n.tag in closes:
                    here = n.parent
            here = Node(tag, here, m[3])
    unended = UNENDED.search(html, at)
    add(html[at:unended.start() if unended else len(html)])
    flush()
    return out


def score(text: str, node: Node, links: float, tag: str) -> float:
    """Above 0: content. The innermost hint counts whole, outer ones by :data:`OUTER`."""
    hint, found, n = 0.0, False, node
    while n:
        if n.hint:
            hint += n.hint * (OUTER if found else 1.0)
            found = True
        n = n.parent
    words = text.count(" ") + 1
    s = hint + min(0.6 * math.log2(words) - 1.0, 2.5) - 4.0 * links
    if tag in ("p", "blockquote", "pre") or tag in HEADINGS:
        s += 1.0
    if text[-1] in ".!?…\"”»":
        s += 0.5
    if words <= 30 and FURNITURE.search(text):
        s -= 3.0
    return s


def distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        else:
            break
        steps += 1
    return steps


def minimum_cut(scores: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Whether each node is on the source's side of the minimum cut. ``edges``: symmetric."""
    label: list[bool | None] = [None] * len(scores)
    scores = list(scores)
    queue = deque(range(len(scores)))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(scores[i]) >= sum(w for j, w in edges[i].items() if label[j] is None):
            label[i] = scores[i] > 0
            for j, w in edges[i].items():
                if label[j] is None:
                    scores[j] += w if label[i] else -w
                    queue.append(j)
    free = [i for i, x in enumerate(label) if x is None]
    if free:
        source, sink = -1, -2
        cap: dict[int, dict[int, float]] = {source: {}, sink: {}, **{i: {} for i in free}}
        for i in free:
            cap[i].update((j, w) for j, w in edges[i].items() if label[j] is None)
            a, b = (source, i) if scores[i] > 0 else (i, sink)
            cap[a][b] = abs(scores[i])
            cap[b].setdefault(a, 0.0)
        side = _max_flow(cap, source, sink)
        for i in free:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(cap: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Dinic's algorithm; returns what the source still reaches."""
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        rest = {i: iter(list(cap[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                path = [source]
                rest = {i: iter(list(cap[i])) for i in level}
                continue
            for j in rest[i]:
                if cap[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level.pop(i, None)
                if path:
                    rest[path[-1]] = iter(list(cap[path[-1]]))


def extract(html: str | None) -> tuple[str, int, int]:
    """The main text, how many blocks the page has, how many of them are content."""
    found = blocks(html or "")
    edges: list[dict[int, float]] = [{} for _ in found]
    last: dict[Node, int] = {}
    for k, (_, node, _, _) in enumerate(found):
        links = {}
        if k:
            links[k - 1] = ADJACENT * math.exp(-distance(found[k - 1][1], node) / REACH)
        up = node.parent or node
        if up in last:
            links[last[up]] = links.get(last[up], 0.0) + SIBLING
        last[up] = k
        for j, w in links.items():
            edges[k][j] = edges[k].get(j, 0.0) + w
            edges[j][k] = edges[j].get(k, 0.0) + w
    label = minimum_cut([score(*b) for b in found], edges)
    kept = [b[0] for b, x in zip(found, label) if x]
    return " ".join(kept), len(found), len(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, n_blocks, n_content_blocks."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract(h) for h in b.column(2).to_pylist()]
            yield batch([id_col, url, "text", "n_chars", "n_blocks", "n_content_blocks"],
                        [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()),
                         pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                         pa.array([r[2] for r in rows], pa.int32())])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return pages.select(id_col, url, html).mapInArrow(
        run, schema + ", text string, n_chars long, n_blocks int, n_content_blocks int")
