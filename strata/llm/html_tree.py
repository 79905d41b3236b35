"""A forgiving reader of HTML: tokens by one regular expression, a tree by the rules of implied end tags."""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=\x00]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
# Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul br".split())
CLOSES_P = BLOCK - frozenset("body head html br td th tr tbody thead tfoot option optgroup legend title".split())
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot", ("table",)), "tfoot": ("tbody thead tfoot", ("table",))}
DEEPEST = 512  # what is nested deeper stays flat, as in browsers
INLINE_ENDS = frozenset("a abbr b big cite code em font i kbd label mark q s samp small span strike strong sub sup tt u var".split())


class Node:
    __slots__ = ("tag", "raw", "parent", "items", "depth", "_attrs")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.parent, self.items, self._attrs = tag, raw, parent, [], None
        self.depth = parent.depth + 1 if parent else 0

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for m in ATTRIBUTE.finditer(self.raw):
                self._attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return self._attrs


def parse(html: str) -> Node:
    """The tree of a document; a node's items are strings (as written, character references and all) and nodes."""
    root = here = Node("#root", "", None)
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            here.items.append(html[at:])
            break
        if lt > at:
            here.items.append(html[at:lt])
        m = TOKEN.match(html, lt) or LOOSE.match(html, lt)
        if not m:
            here.items.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m.lastindex:
            continue
        tag = m[2].lower()
        if m[1]:
            here = _close(here, tag)
            continue
        here = _imply(here, tag)
        node = Node(tag, m[3] or "", here)
        here.items.append(node)
        if tag in VOID or node.depth >= DEEPEST and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(html, at)
            node.items.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        here = node
    return root


def _up(here: Node, tags, stop) -> Node | None:
    """The nearest open node among the tags, below the nearest of the stops."""
    x = here
    while x.parent is not None:
        if x.tag in tags:
            return x
        if x.tag in stop:
            return None
        x = x.parent
    return None


_P_STOP = frozenset(("td", "th", "caption", "button", "article", "section", "div", "main", "aside", "nav", "footer", "header", "li", "blockquote", "figure", "form", "body"))


def _imply(here: Node, tag: str) -> Node:
    """Where a start tag belongs: what it ends without an end tag is left."""
    if tag in CLOSES_P:
        p = _up(here, ("p",), _P_STOP)
        if p:
            here = p.parent
    if tag in ENDS:
        tags, stop = ENDS[tag]
        x = _up(here, tags.split(), stop)
        if x:
            here = x.parent
    return here


def _close(here: Node, tag: str) -> Node:
    """After an end tag: its node's parent; an inline end tag doesn't reach beyond a block."""
    x = _up(here, (tag,), BLOCK - {tag} if tag in INLINE_ENDS else ("body", "html") if tag == "p" else ())
    return x.parent if x else here


def squeeze(text: str) -> str:
    """White space runs as one space, trimmed."""
    return " ".join(text.split())
