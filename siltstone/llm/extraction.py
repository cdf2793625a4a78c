"""Main text of web pages by composite text density.

A page becomes a tree. For every node: C characters, T tags (of blocks and links), LC and LT those inside links; its
composite density is C/T, adjusted by the share of links: C / T * log(C / LC * T / LT) to the base
log(C / (C - LC) * LC + LC_body / C_body * C + e). The density sum of a node adds its children's densities.

1. The node with the largest density sum is the core; ties go to the first one.
2. The threshold is the least density on the path from the body to the core. From the core the article grows upwards:
   a parent is taken if what it adds lies, for the most part, in children that reach the threshold, and is worth at
   least a tenth of the article so far. An <article> or <main> around the core is taken, and never left again.
3. What the page labels as something else (menus, adverts, forms, comments and so on: by tag, role, or class and id) is
   no core and adds nothing to a sum, and is cut out of the article. A label on nearly all of the page's text, or around an <article>, doesn't count where no <article> is elsewhere.

Text inside a block becomes one line: character references decoded, white space runs (and line breaks) one space,
trimmed; blocks are joined in page order by one space. Reading takes time in proportion to the page's length.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, table

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"""=\s*["']|>""")
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""")
# fixed values: the parts of HTML and the names pages give to what isn't their article
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_UNSEEN = frozenset("title script style noscript iframe template svg math canvas object noembed noframes".split())
_ASIDE = frozenset("nav aside footer form button select textarea input dialog menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments respond disqus"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended paywall pagination pager toolbar skip".split()
)
#: words that say nothing beside one of the names, as in comment-list or site-footer
_NEUTRAL = frozenset("list container wrapper wrap box area section block bar widget site page top bottom left right inner outer slot unit links link buttons item items thread group panel global main module text label row col".split())
#: an opening tag of the key closes an open one of the value, inside the nearest container
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_CONTAINERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}


class Node:
    __slots__ = ("tag", "parts", "parent", "attributes", "label", "unseen", "block", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.unseen, self.label = tag in _UNSEEN, False
        self.block = self if parent is None or tag not in _INLINE else parent.block
        self.parts: list[Node | str] = []


def _names_other(word: str) -> bool:
    if word in _NAMES:
        return True
    parts = [p for p in re.split(r"[-_]+", word) if p]
    return not _NAMES.isdisjoint(parts) and all(p in _NAMES or p in _NEUTRAL for p in parts)


def _labelled(node: Node) -> bool:
    """Whether the page marks an element as something other than its article."""
    if node.tag in _ASIDE:
        return True
    if not node.attributes or node.tag in ("article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and any(_names_other(w) for w in value.split()):
            return True
    return False


class _Open:
    """The path of open elements, and where on it each tag is open."""

    def __init__(self, root: Node):
        self.path, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        while len(self.path) > depth:
            self.at[self.path.pop().tag].pop()

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else 0

    def first_below(self, tag: str, depth: int) -> int | None:
        at = self.at.get(tag, [])
        i = bisect_right(at, depth)
        return at[i] if i < len(at) else None


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that began before `at` ends: after its >, quoted values aside; -1 if it never does."""
    while m := _QUOTE.search(page, at):
        if m[0] == ">":
            return m.end()
        quote = m[0][-1]
        if m.end() > last[quote]:  # never closed: the value ends with the tag
            return page.find(">", m.end()) + 1 or -1
        at = page.index(quote, m.end()) + 1
    return -1


def parse(page: str) -> Node:
    """The page's tree under its body; unclosed and stray tags are taken as browsers take them, roughly.

    Tags of html, head and body are ignored, so text before, between and after them counts. A tag or comment that the
    page's end cuts off is no text.
    """
    root = Node("body", None)
    opened, at, n = _Open(root), 0, len(page)
    last = {c: page.rfind(c) for c in ("\"", "'", "]]>")}
    while at < n:
        node = opened.path[-1]
        start = page.find("<", at)
        if start < 0:
            node.parts.append(page[at:])
            break
        if start > at:
            node.parts.append(page[at:start])
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?") or mark == "/" and not _NAME.match(page, start + 2):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4) + 3
                at = end if end > 2 else n
            elif page.startswith("<![CDATA[", start) and start < last["]]>"]:
                end = page.index("]]>", start)
                node.parts.append(html.escape(page[start + 9 : end]))
                at = end + 3
            else:
                at = page.find(">", start) + 1 or n
            continue
        closing = mark == "/"
        m = _NAME.match(page, start + 1 + closing)
        if not m:  # a bare <
            node.parts.append("<")
            at = start + 1
            continue
        at = _tag_end(page, m.end(), last)
        if at < 0:
            break
        tag, attributes = m[0].lower(), page[m.end() : at - 1]
        if tag in ("html", "head", "body"):  # their attributes say nothing about the text
            continue
        if closing:
            if depth := opened.last(tag):
                opened.close(depth)
            elif tag in ("p", "br"):
                node.parts.append(Node(tag, node))
            continue
        if tag in _P_CLOSERS and node.block.tag == "p":
            opened.close(opened.last("p"))
        if tag in _CLOSES:
            inside = max(opened.last(c) for c in _CONTAINERS[tag])
            found = [d for c in _CLOSES[tag] if (d := opened.first_below(c, inside)) is not None]
            if found:
                opened.close(min(found))
        node = opened.path[-1]
        child = Node(tag, node, attributes)
        node.parts.append(child)
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            child.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID and not attributes.endswith("/"):
            opened.push(child)
    return root


def _measure(root: Node) -> list[Node]:
    """Counts, labels, densities and sums for every seen node, bottom up; the nodes in document order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.unseen)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len(_SPACE.sub(" ", p).strip())
            elif not p.unseen:
                node.chars += p.chars
                node.tags += p.tags + (p.tag not in _INLINE or p.tag == "a")
                node.link_chars += p.chars if p.tag == "a" else p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
    of_links = root.link_chars / max(1, root.chars)
    holders: set[int] = set()
    marked = [x for x in order if x.tag in ("article", "main")]
    for x in marked:
        while x is not None and id(x) not in holders:
            holders.add(id(x))
            x = x.parent
    inside = {id(root): False}
    for x in order:
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        x.density = 0.0
        if c:
            base = math.log(c / max(1, c - x.link_chars) * x.link_chars + of_links * c + math.e)
            adjusted = math.log(max(1.0, c / lc * t / lt))
            x.density = c / t * (adjusted / math.log(base) if base > 1 else adjusted)
        if x is not root:
            inside[id(x)] = inside[id(x.parent)] or x.tag in ("article", "main")
            # a header inside an article is its own; a label on nearly all text, or around an article, is none
            own = _labelled(x) or x.tag == "header" and not inside[id(x)]
            x.label = bool(own and id(x) not in holders and (marked or x.tag in _ASIDE and x.tag != "form" or 20 * c < 19 * root.chars)) or x.parent.label
    for x in order:
        x.total = sum(p.density for p in x.parts if isinstance(p, Node) and not p.unseen and not p.label)
    return order


def _path(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def article(root: Node) -> Node:
    """The subtree that holds the article; see the module's text."""
    order = _measure(root)
    best = max((x for x in order if x.tag not in _INLINE and not x.label), key=lambda x: x.total)
    path = _path(best)
    least = min(x.density for x in path)
    marked = [x for x in path if x.tag in ("article", "main")]
    if marked:
        return marked[-1]
    taken = best
    for up in path[1:]:
        rest = [p for p in up.parts if isinstance(p, Node) and not p.unseen and not p.label and p not in path]
        worth = sum(p.chars for p in rest if p.density >= least) + sum(len(p.strip()) for p in up.parts if isinstance(p, str))
        if 10 * worth >= taken.chars and 2 * worth >= sum(p.chars for p in rest):
            taken = up
    return taken


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks, in page order."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not x.unseen and (not x.label or x is node):
            if x.tag not in _INLINE:
                close()
                stack.append(None)
            stack.extend(reversed(x.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    return " ".join(blocks(article(parse(page)))) if page else ""


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype="object")

    return text(page)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html, ...).

    Null and empty pages, and pages without any text, have the empty text; long pages are read whole, in linear time. Ids and urls stay as they are, nulls
    included; repeated rows are extracted each; other columns are ignored; an empty table gives an empty result.
    """
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages, from their whole html; nulls, empty and repeated rows: see extract."""
    small_batches(spark)
    return extract(table(spark, sf_dir, "pages"))
