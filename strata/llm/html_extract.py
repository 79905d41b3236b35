"""HTML extraction by tree scoring.

Paragraphs pass points (one, one for each comma, one for each 100 characters up to
three) to their parent whole and to the grandparent by half, further up by less; an
article or main above them gets them whole, as its parts are one text; class and id names add or take some, and a container's points are discounted by
the share of its text that is links. The best container is kept, and those of its
siblings that score well enough or are prose; within them, menus, notices,
adverts, forms and reader comments are left out.

Defined results: null or blank html has an empty text; a page whose tree has no
scored container gives the blocks of its body that aren't boilerplate; rows are
judged one by one, repeated ones alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Renamed, slices
from strata.llm.html_tree import BLOCK, Node, parse, squeeze

# Names of parts that aren't the article; fixed values.
DROP_TAGS = frozenset("script style noscript template iframe noembed noframes svg head title nav menu footer aside form button input select option textarea fieldset dialog search".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tooltip".split())
# What parts that aren't the article call themselves, by the kinds of part that the text is to be without.
PARTS = {
    "menus": "menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar tabs skip",
    "headers": "header banner masthead",
    "footers": "footer foot copyright imprint",
    "sidebars": "sidebar aside widget related recommended",
    "notices": "notice notices cookie cookies consent gdpr popup modal overlay",
    "adverts": "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored",
    "forms": "form login signup subscribe subscription newsletter search",
    "comments": "comment comments reply replies response responses discussion",
    "sharing": "share sharing social",
}
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:" + "|".join(w for words in PARTS.values() for w in words.split()) + r")(?:$|[\s_-])", re.I)
LIKELY = re.compile("article|content|main|prose|story|text", re.I)
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4".split())
KEPT_WHOLE = frozenset("article main body html #root".split())
WHOLE = frozenset(("article", "main"))
TEXT_LEAST, SIBLING_SHARE, SIBLING_LEAST = 25, 0.2, 10.0


def dropped(x: Node, names: bool = True) -> bool:
    """Whether the node is boilerplate by what it calls itself; without ``names``, by tags and roles alone."""
    if x.tag in KEPT_WHOLE:
        return False
    if x.tag in DROP_TAGS:
        return True
    if x.tag == "header":
        return not any(p.tag in ("article", "main") for p in _above(x))
    if not x.raw:
        return False
    a = x.attrs
    if a.get("role", "").lower() in DROP_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return names and x.tag not in ("p", "h1") and bool(UNLIKELY.search(f"{a.get('class', '')} {a.get('id', '')}")) and not _holds_article(x)


def _holds_article(x: Node) -> bool:
    """A wrapper that is named after a part of the page, such as has-sidebar, isn't that part."""
    stack = [c for c in x.items if isinstance(c, Node)]
    while stack:
        c = stack.pop()
        if c.tag in ("main", "article") and not any(p.tag in ("aside", "footer", "nav") for p in _above(c)):
            return not any("comment" in p.attrs.get("class", "").lower() + p.attrs.get("id", "").lower() for p in _above(c) if p.raw)
        stack += [k for k in c.items if isinstance(k, Node)]
    return False


def _above(x: Node) -> Iterator[Node]:
    while x.parent is not None:
        x = x.parent
        yield x


def score(root: Node, names: bool = True) -> tuple[dict[Node, float], dict[Node, tuple[int, int]]]:
    """Points of the containers, discounted by link density; characters and linked characters of every node."""
    points: dict[Node, float] = {}
    chars: dict[Node, tuple[int, int]] = {}
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.items if isinstance(c, Node) and not dropped(c, names)]
    commas: dict[Node, int] = {}
    for x in reversed(order):
        n = linked = comma = 0
        for c in x.items:
            if isinstance(c, str):
                s = squeeze(unescape(c)) if "&" in c else squeeze(c)
                n += len(s)
                comma += s.count(",")
            elif c in chars:
                m, k = chars[c]
                n, linked, comma = n + m, linked + k, comma + commas[c]
        chars[x], commas[x] = (n, n if x.tag == "a" else linked), comma
    for x in order:
        n = chars[x][0]
        if x.tag not in SCORED or n < TEXT_LEAST or x.parent is None:
            continue
        worth, share = 1 + commas[x] + min(n // 100, 3), 1.0
        for level, up in enumerate(_above(x)):
            whole = up.tag in WHOLE
            if (whole or level <= 4) and (up.tag not in SCORED or level):
                if up not in points:
                    points[up] = _first(up)
                points[up] += worth * (1.0 if whole else share)
                share = 0.5 if level == 0 else share * 0.6
    return {x: v * (1 - chars[x][1] / max(1, chars[x][0])) for x, v in points.items()}, chars


def _first(x: Node) -> float:
    base = 15.0 if x.tag in WHOLE else 5.0 if x.tag in ("div", "section") else -5.0 if x.tag in ("ul", "ol", "dl", "form", "th") else 0.0
    return base + (5.0 if x.raw and LIKELY.search(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}") else 0.0)


def chosen(root: Node, names: bool = True) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    points, chars = score(root, names)
    if not points:
        return [root]
    best = max(points, key=lambda x: points[x])
    if best.parent is None:
        return [best]
    least = max(SIBLING_LEAST, SIBLING_SHARE * points.get(best, 0.0))
    out = []
    for x in best.parent.items:
        if not isinstance(x, Node) or dropped(x, names):
            continue
        n, linked = chars.get(x, (0, 0))
        same = best.raw.strip() and x.raw.strip() == best.raw.strip() and x.tag == best.tag
        if x is best or points.get(x, 0.0) + (0.2 * points[best] if same and best in points else 0.0) >= least:
            out.append(x)
        elif x.tag == "p" and n and (n > 80 and linked < 0.25 * n or not linked and n <= 80):
            out.append(x)
        elif x.tag in ("h1", "h2") and not linked:
            out.append(x)
    return out


def blocks(nodes: list[Node], names: bool = True) -> list[str]:
    """Text blocks in page order: white space single, character references decoded, empty ones left out."""
    out, parts = [], []

    def flush() -> None:
        if parts:
            s = squeeze(unescape("".join(parts)))
            parts.clear()
            if s:
                out.append(s)

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not dropped(x, names):
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return out


def main_text(html: str) -> str:
    """The article's blocks joined by line ends; empty if there is none."""
    root = parse(html)
    found = blocks(chosen(root))
    return "\n".join(found or blocks(chosen(root, False), False))  # a page that is nothing but named parts is judged without the names


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of every page; kept columns of these two names give way."""
    named = Renamed(pages.select(*(F.col(f"`{c}`") for c in keep if c not in ("text", "n_chars"))))
    own = pages.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(named.names)), F.col(html).alias("html"))
    schema = named.df.schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return own.mapInArrow(run, schema).select(*named.back(), "text", "n_chars")
