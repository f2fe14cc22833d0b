"""Pages as block elements and blocks of text: one pass over the markup, linear in its length.

Elements close as browsers close them (a paragraph at the next block, a list item at the next one,
an end tag closes what stands open above its start). Elements that start a block of text become
nodes; what stands inline belongs to its block, or is left out where its role says that it is no text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

# Elements of HTML by what they do to the text around them.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = HEADINGS | {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "ul", "li", "dd", "dt",
}
BLOCKS = CLOSES_P | {"html", "body", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "frameset"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
P_BARRIERS = ("table", "td", "th", "caption", "button", "object", "template")
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: What a start tag closes, up to the nearest barrier.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}

# What names the article, and what is never part of one.
NOISE_TAGS = {
    "aside", "button", "canvas", "dialog", "embed", "fieldset", "footer", "form", "head", "iframe", "input", "link", "menu", "meta",
    "nav", "noembed", "noframes", "noscript", "object", "script", "search", "select", "style", "svg", "template", "textarea", "title",
}
NOISE_ROLES = {
    "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar",
}
NOISE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
    "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
CONTENT_ROLES = {"article", "main"}
_TEXT_ROOTS = {"html", "body", "main"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Longer values of a class or an id are not kept for the next element that has them.
_HELD_NAME = 256
_DENIED = re.compile(r"(?i)(no|has|with|without)[-_]")

NOISE, OPEN, CONTENT = 0, 1, 2


@dataclass
class Node:
    parent: int
    name: str  # tag and classes
    role: int  # NOISE, OPEN or CONTENT; of the element itself
    children: list[int] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)  # what it shows but text: link targets, picture sources


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  # node and text, in page order

    def kept(self) -> tuple[list[bool], bool]:
        """Of every node, whether roles leave its text in; and whether the page names no article, so that all is open."""
        noise, named = [], []
        for i, node in enumerate(self.nodes):
            noise.append(node.role == NOISE or (i > 0 and noise[node.parent]))
            if node.role == CONTENT and not noise[i]:
                named.append(i)
        roots = {i for i in named if self.nodes[i].name.partition(".")[0] == "article"} or set(named)
        inside: list[bool] = []
        for i, node in enumerate(self.nodes):
            inside.append(i in roots or (inside[node.parent] if i else not roots))
        return [x and not y for x, y in zip(inside, noise, strict=True)], not roots


def _attributes(part: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(part):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ('"', "'") else value))
    return out


@lru_cache(maxsize=4096)
def _named(value: str) -> frozenset[str]:
    """Words of a class or an id, in lower case, each also without an s at its end."""
    words = {word.lower() for name in value.split() if not _DENIED.match(name) for word in _NAMES.findall(name)}
    return frozenset(words | {word.removesuffix("s") for word in words})


def _role(tag: str, own: dict[str, str], in_article: bool) -> int:
    if tag in NOISE_TAGS:
        return NOISE
    role = own.get("role", "").strip().lower() if own else ""
    if tag not in _TEXT_ROOTS:
        named = [(_named if len(own[key]) <= _HELD_NAME else _named.__wrapped__)(own[key]) for key in ("class", "id") if own.get(key)]
        if role in NOISE_ROLES or any(not names.isdisjoint(NOISE_NAMES) for names in named):
            return NOISE
        if not in_article and (tag == "header" or any("header" in names for names in named)):
            return NOISE
    if tag in ("article", "main") or role in CONTENT_ROLES or (own and own.get("itemprop", "").lower() == "articlebody"):
        return CONTENT
    return OPEN


class _Builder:
    def __init__(self) -> None:
        self.page = Page([Node(0, "root", OPEN)], [])
        self.stack: list[tuple[str, int, bool]] = []  # open elements: tag, node, whether nothing in it is text
        self.open: dict[str, list[int]] = {}  # places in the stack of each tag
        self.parts: list[str] = []

    def here(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (0, False)

    def text(self, value: str) -> None:
        if not self.here()[1]:
            self.parts.append(value)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.page.blocks.append((self.stack[-1][1] if self.stack else 0, text))
            self.parts.clear()

    def place(self, tags: tuple[str, ...]) -> int:
        """Of the open elements with these tags the last one's place in the stack, or -1."""
        last, places = -1, self.open
        for tag in tags:
            if (own := places.get(tag)) and own[-1] > last:
                last = own[-1]
        return last

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag, _, mute = self.stack[-1]
            if tag in BLOCKS and not mute:
                self.flush()
            self.stack.pop()
            self.open[tag].pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in HEAD:
            self.close_to(self.open["head"][-1])
        if tag in CLOSES_P and self.open.get("p") and (at := self.open["p"][-1]) > self.place(P_BARRIERS):
            self.close_to(at)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.close_to(len(self.stack) - 1)
        if tag in IMPLIED:
            closed, barriers = IMPLIED[tag]
            if (at := self.place(closed)) >= 0 and at > self.place(barriers):
                self.close_to(at)
        if tag == "br":
            self.text(" ")
            return
        node, mute = self.here()
        if not mute:
            own = _attributes(attributes) if attributes.strip(" /") else {}
            role = _role(tag, own, bool(self.open.get("article") or self.open.get("main")))
            if tag in BLOCKS:
                self.flush()
                nodes = self.page.nodes
                name = ".".join([tag, *sorted(set(own["class"].split()))]) if own.get("class") else tag
                nodes.append(Node(node, name, role))
                nodes[node].children.append(len(nodes) - 1)
                node = len(nodes) - 1
            else:
                mute = role == NOISE
            if own and not mute:
                self.page.nodes[node].marks += [own[key] for key in ("href", "src") if own.get(key)]
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, node, mute))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag in ("html", "body"):
            pass  # what follows still belongs to the page
        elif self.open.get(tag):
            at = self.open[tag][-1]
            if tag in TABLE or at > self.place(("td", "th")):
                self.close_to(at)
        elif tag in HEADINGS and (at := self.place(tuple(HEADINGS))) >= 0:
            self.close_to(at)


def parse(html: str | None) -> Page:
    """Nodes and blocks of a page; a null or empty page has a root and no blocks.

    White space inside a block is one space. A tag, comment or script that never ends takes the rest.
    """
    page, at, size = _Builder(), 0, len(html or "")
    while at < size:
        cut = html.find("<", at)
        if cut < 0:
            cut = size
        if cut > at:
            page.text(unescape(html[at:cut]))
        if cut == size:
            break
        found = _TAG.match(html, cut)
        if found:
            at, tag = found.end(), found[2].lower()
            if found[1]:
                page.end(tag)
                continue
            page.start(tag, found[3])
            if tag in RAW:
                last = _RAW_END[tag].search(html, at)
                at = last.start() if last else size
        elif html.startswith("<!--", cut):
            if html.startswith((">", "->"), cut + 4):
                at = html.index(">", cut + 4) + 1
            else:
                last = _COMMENT_END.search(html, cut + 4)
                at = last.end() if last else size
        elif html[cut + 1 : cut + 2] in ("!", "?", "/") and cut + 1 < size:
            last = html.find(">", cut)
            at = last + 1 if last >= 0 else size
        elif html[cut + 1 : cut + 2].isascii() and html[cut + 1 : cut + 2].isalpha():
            at = size  # a tag that never ends
        else:
            page.text("<")
            at = cut + 1
    page.flush()
    return page.page
