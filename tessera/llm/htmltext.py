"""Main text of web pages by composite text density.

Each page is parsed into a tree. Parts that are no article by their element, role,
class or id (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments) are pruned; a header inside an article or main belongs to it. A class or id counts as a whole and by its parts, but a node
is not pruned for it that holds the page's longest article or main element, or, by a mere
part of a name ("has-sidebar"), any such element that is no list of links; nor one that
holds most of the page's text outside links when no such element is elsewhere. Headers, footers, sidebars and
forms that hold the longest article stay, as does a form that holds most of the text; an article named a card or
teaser goes beside one that isn't. Reader comments are also told by their shape: elements of one kind that follow each other
after a paragraph of the article, each with an author or a date. Every remaining node gets a composite text
density: characters per tag, scaled down by the share of link characters and link
tags. The node whose children's densities have the largest sum is the centre of the
content; the smallest density on its path to the body is the threshold. The content
is the container around the centre (at least its outermost article, else main, element
if it has one), widened along that path to the last container where it gains siblings,
elements or bare text, at or above the threshold, or articles that are no list of links.
In it, blocks of three links or more go that are below the threshold and two thirds of whose
characters are links, unless all its text is such; all other text in it is kept. (The
threshold alone would drop short paragraphs and sections of an article, so it chooses between
blocks of links and text only.)

White space inside a block becomes one space; blocks are joined by one newline.

Defined results: null or empty html, and pages without text, give an empty string;
broken markup is read as far as it goes; repeated rows get equal results; columns
named like the outputs are replaced.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import frames

#: HTML element groups.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "#root", "blockquote", "center", "details"}
DROPPED = {"head", "script", "style", "noscript", "template", "nav", "menu", "button", "select", "option", "textarea", "iframe", "object", "svg", "canvas", "audio", "video", "dialog", "title"}
#: Elements that go unless they hold the page's longest article; a form that holds most of the text stays too.
FRAMES = {"header", "footer", "aside", "form"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "alertdialog", "dialog", "note"}
NAMES = {
    "ad", "ads", "adslot", "adv", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookiebar", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promotion", "reactions", "related", "replies", "respond", "responses", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
#: Names of reader comments, which may be longer than the page's own text.
COMMENTS = {"comment", "comments", "disqus", "reactions", "replies", "respond", "responses"}
#: Names of articles that only point to others, and of what tells who wrote a comment and when.
TEASERS = {"card", "teaser"}
BYLINES = {"author", "avatar", "byline", "date", "posted", "time", "timestamp", "user", "username"}
#: An element that starts ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_STOPS = CONTAINERS | {"li", "table", "th"}
_P_ENDERS = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


class Node:
    __slots__ = ("tag", "kind", "parent", "parts", "pruned", "inside", "byline", "names", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, pruned: bool, kind: str | None = None):
        self.tag, self.parent, self.pruned = tag, parent, pruned
        self.kind = kind or tag  # main for what has that role
        self.inside = parent is not None and (parent.inside or parent.kind in ("article", "main"))
        self.byline = False  # whether it tells who wrote something or when
        self.parts: list[Node | str] = []
        self.names: set[str] | None = None  # whole names, of a node with a name of boilerplate
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _tokens(attrs: list[tuple[str, str | None]]) -> tuple[set[str], set[str]]:
    """Class names and ids, whole and in parts."""
    given = [v.lower() for k, v in attrs if k in ("class", "id") and v]
    return {x for v in given for x in v.split()}, {x for v in given for x in re.split(r"[^a-z0-9]+", v)}


def _boilerplate(tag: str, kind: str, attrs: list[tuple[str, str | None]], parts: set[str]) -> bool:
    if tag in DROPPED:
        return True
    if kind in ("html", "body", "main", "article"):
        return kind == "article" and bool({"comment", "comments"} & parts)
    return any(k == "hidden" or k == "role" and (v or "").lower() in ROLES for k, v in attrs)


def _names(tag: str, kind: str, whole: set[str], parts: set[str], inside: bool) -> set[str] | None:
    """The whole class names and ids, if they or parts of them are names of boilerplate, and an
    element that is boilerplate by its kind."""
    if kind == "article":
        return TEASERS & whole or None
    if kind in ("html", "body", "main"):
        return None
    if tag in FRAMES and not (tag == "header" and inside):
        return whole | {tag}
    return whole if (NAMES - {"header"} if inside else NAMES) & parts else None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None, False)
        self.nodes = [self.root]  # parents before children
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag

    def _close_to(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _find(self, tags: set[str], stop: set[str]) -> int:
        """The place of the innermost open element of these tags, unless one to stop at is further in; else 0."""
        at = self._last(tags)
        return at if at and at > self._last(stop) else 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _P_ENDERS and (p := self._find({"p"}, _P_STOPS)):
            self._close_to(p)
        if tag in ENDS and (old := self._find(ENDS[tag], {"ul", "ol", "dl", "table", "select"})):
            self._close_to(old)
        parent = self.open[-1]
        kind = "main" if any(k == "role" and (v or "").lower() == "main" for k, v in attrs) else tag
        node = Node(tag, parent, parent.pruned, kind)
        if not node.pruned:
            whole, parts = _tokens(attrs)
            node.pruned = _boilerplate(tag, kind, attrs, parts)
            node.names = _names(tag, kind, whole, parts, node.inside)
            node.byline = tag == "time" or bool(BYLINES & parts)
        parent.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        stop = set() if tag in ("body", "html") else {"body"} if tag in BLOCKS else BLOCKS - {"p"}
        if old := self._find({tag}, stop - {tag}):
            self._close_to(old)

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _prune_named(nodes: list[Node]) -> None:
    """Prunes nodes with names of boilerplate, but none that hold the content."""
    if not any(n.names is not None and not n.pruned for n in nodes):
        return
    held = {n: [0, 0, 0] for n in nodes if not n.pruned}  # characters, those in links, articles
    longest, most = None, 0
    for n in reversed(nodes):
        if n.pruned:
            continue
        own = held[n]
        own[0] += sum(len(" ".join(x.split())) for x in n.parts if isinstance(x, str))
        if n.tag == "a":
            own[1] = own[0]
        elif n.kind in ("article", "main") and (plain := own[0] - own[1]) and plain >= own[1]:
            own[2] += 1
            longest, most = (n, plain) if plain >= most else (longest, most)
        if n.parent is not None:
            for k, x in enumerate(own):
                held[n.parent][k] += x
    around = set()
    teasers = longest is not None and longest.names is not None
    while longest is not None:
        around.add(longest)
        longest = longest.parent
    chars, links, articles = held[nodes[0]]
    for n in nodes:
        if n.pruned or n.parent is None:
            continue
        own = held[n]
        n.pruned = n.parent.pruned
        if n.names is None or n in around or n.pruned:
            continue
        if n.kind == "article":
            n.pruned = not teasers  # a page of teasers is made of them
        elif n.tag in FRAMES and n.tag in n.names and n.tag != "form":
            n.pruned = True
        elif not (own[2] and not n.names & (NAMES | {"form"})):
            n.pruned = own[2] < articles or bool(n.names & COMMENTS) or 2 * (own[0] - own[1]) <= chars - links


def _prune_replies(nodes: list[Node]) -> None:
    """Prunes reader comments by their shape: of one kind of element at least two that follow each other under one
    node, each with a line that tells who wrote it or when, after a paragraph of the article that stands outside them."""
    signed, written, place = set(), set(), {n: k for k, n in enumerate(nodes)}
    for n in reversed(nodes):
        if n.pruned or n.parent is None:
            continue
        if n.byline or n in signed:
            signed.add(n.parent)
        if n.tag == "p" and any(isinstance(x, str) and x.strip() for x in n.parts) or n in written:
            written.add(n.parent)
    first = next((k for k, n in enumerate(nodes) if n.tag == "p" and not n.pruned and n.inside and any(isinstance(x, str) and len(x.split()) > 5 for x in n.parts)), None)
    if first is None:
        return
    for n in nodes:
        below = [x for x in n.parts if isinstance(x, Node) and not x.pruned]
        items = [x for x in below if x in signed and x in written and x.kind in ("div", "li", "section", "article", "dd")]
        if n.inside and not n.pruned and len(items) >= 2 and len({x.tag for x in items}) == 1 and place[items[0]] > first and all(x in items or x.tag in ("h2", "h3", "h4") or x in signed for x in below):
            n.pruned = True
    for n in nodes:
        n.pruned = n.pruned or n.parent is not None and n.parent.pruned


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + share * chars + math.e)
    adjusted = chars * max(tags, 1) / (max(link_chars, 1) * max(link_tags, 1))
    return chars / max(tags, 1) * max(math.log(adjusted), 0.0) / base


def _measure(nodes: list[Node], body: Node) -> float:
    """Sets the nodes' counts and densities; the share of link characters in all."""
    for n in reversed(nodes):
        if n.pruned:
            continue
        n.chars += sum(len(" ".join(x.split())) for x in n.parts if isinstance(x, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if n.pruned or not n.chars:
            continue
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        below = [x.density for x in n.parts if isinstance(x, Node) and not x.pruned]
        n.total = sum(below) if any(below) else n.density
    return share


def _content(tree: _Tree) -> Node:
    body = next((n for n in tree.nodes if n.tag == "body"), tree.root)
    _prune_named(tree.nodes)
    _prune_replies(tree.nodes)
    share = _measure(tree.nodes, tree.root)
    centre = max((n for n in tree.nodes if not n.pruned), key=lambda n: n.total)  # the first of equals
    path = [centre]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    region = next(n for n in path if n.tag in CONTAINERS)
    for tag in ("article", "main"):
        if of := [n for n in path if n.kind == tag]:
            region = of[-1]
            break

    def dense(x: Node | str) -> bool:
        if isinstance(x, Node):
            return not x.pruned and (x.density >= threshold or x.tag == "article" and x.chars >= max(1, 2 * x.link_chars))
        return bool(n := len(" ".join(x.split()))) and _density(n, 0, 0, 0, share) >= threshold

    for inner, outer in zip(path, path[1:]):
        if outer.tag in CONTAINERS and threshold > 0 and any(x is not inner and dense(x) for x in outer.parts):
            region = max(region, outer, key=path.index)
    _prune_links(region, threshold)
    return region


def _prune_links(region: Node, threshold: float) -> None:
    """Prunes blocks of links in the region, unless nothing would be left."""
    found, todo, left = [], [region], region.chars
    while todo:
        n = todo.pop()
        if n is not region and n.tag in BLOCKS and n.link_tags >= 3 and 3 * n.link_chars >= 2 * n.chars and n.density < threshold:
            found.append(n)
            left -= n.chars
        else:
            todo.extend(x for x in n.parts if isinstance(x, Node) and not x.pruned)
    if left > 0:
        for n in found:
            n.pruned = True


def main_text(html: str | None) -> str:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    blocks: list[str] = []
    here: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(here).split()):
            blocks.append(line)
        here.clear()

    todo: list = [_content(tree)]
    while todo:
        at = todo.pop()
        if at is None:
            flush()
        elif isinstance(at, str):
            here.append(at)
        elif not at.pruned:
            if at.tag == "br":
                here.append(" ")
            elif at.tag in BLOCKS or at.tag == "#root":
                flush()
                todo.append(None)
            todo.extend(reversed(at.parts))
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the main text and its length in code points."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        texts = [main_text(x) for x in part.column(html).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return frames.append(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute, html)
