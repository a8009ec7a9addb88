"""Person blocks of a page: the one step that needs the element tree.

The Arrow UDF only cuts a page into blocks; every rule that reads a block
(name, position, email, phone) is a Spark expression over its result.
"""

import re
import sys
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline import vocab
from rosterline.functions.entities import FULL_NAME

# executors need not have this package: its functions travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_TYPE = T.ArrayType(T.StructType([
    T.StructField("block_ord", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("strings", T.ArrayType(T.StringType())),
    T.StructField("role_texts", T.ArrayType(T.StringType())),
]))
_NAME = re.compile(FULL_NAME)
_CARD = re.compile("|".join(vocab.CARD_CLASS_WORDS), re.I)
_ROLE = re.compile("|".join(vocab.ROLE_CLASS_WORDS), re.I)
_HIDDEN = {"script", "style", "noscript", "head"}
# fixed values: elements that never hold content, and those that end a paragraph
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}


class _Node:
    __slots__ = ("tag", "css", "ident", "parent", "start", "end", "first", "last")

    def __init__(self, tag, attrs, parent, start, first):
        self.tag, self.parent, self.start, self.first = tag, parent, start, first
        self.css, self.ident = attrs.get("class") or "", attrs.get("id") or ""
        self.end = self.last = None


class _Outline(HTMLParser):
    """Elements of a page as spans over its source and over its text pieces."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.nodes, self.pieces, self.open, self.hidden = html, [], [], [], 0
        self.line_starts = [0] + [m.end() for m in re.finditer("\n", html)]
        self.feed(html)
        self.close()
        self._close_down_to(0, len(html))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def _close_down_to(self, depth: int, at: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            node.end, node.last = at, len(self.pieces)
            self.hidden -= node.tag in _HIDDEN

    def _depth_of(self, tag: str, stop: set[str]) -> int | None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                return depth
            if self.open[depth].tag in stop:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        at = self._offset()
        implied = None
        if tag in _ENDS_PARAGRAPH:
            implied = self._depth_of("p", {"div", "td", "li", "section", "article", "button"})
        elif tag == "li":
            implied = self._depth_of("li", {"ul", "ol"})
        if implied is not None:
            self._close_down_to(implied, at)
        if tag in _VOID:
            return
        parent = self.open[-1] if self.open else None
        node = _Node(tag, dict(attrs), parent, at, len(self.pieces))
        self.open.append(node)
        self.hidden += tag in _HIDDEN
        if not self.hidden:
            self.nodes.append(node)

    def handle_endtag(self, tag):
        depth = self._depth_of(tag, set())
        if depth is not None:
            at = self._offset()
            self._close_down_to(depth, self.html.find(">", at) + 1 or len(self.html))

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)

    def strings(self, node: _Node) -> list[str]:
        return [s for s in (p.strip() for p in self.pieces[node.first:node.last]) if s]


def _person_nodes(page: _Outline) -> list[_Node]:
    cards = [
        n for n in page.nodes
        if n.tag in ("div", "article", "section", "li") and (_CARD.search(n.css) or _CARD.search(n.ident))
    ]
    found = []
    for node in cards:
        # pieces are joined without blanks, so a name counts only where its
        # piece goes on with punctuation or nothing follows it
        text = "".join(page.strings(node))
        if len(text) > 20 and _NAME.search(text):
            found.append(node)
    return found or _sibling_nodes(page)


def _sibling_nodes(page: _Outline) -> list[_Node]:
    """Children of the first list-like parent that holds two or more names."""
    children: dict[_Node, list[_Node]] = {}
    for node in page.nodes:
        if node.tag in ("li", "div", "article") and node.parent is not None:
            children.setdefault(node.parent, []).append(node)
    for parent in page.nodes:
        if parent.tag in ("ul", "div", "section") and len(children.get(parent, ())) >= 2:
            named = [c for c in children[parent] if _NAME.search("".join(page.pieces[c.first:c.last]))]
            if len(named) >= 2:
                return named
    return []


def person_blocks_of(html: str) -> list[dict]:
    page = _Outline(html)
    role_tags = {"p", "span", "div", "h3", "h4", "small", "em", "strong"}
    roles = [n for n in page.nodes if n.tag in role_tags and _ROLE.search(n.css)]
    blocks = []
    for i, node in enumerate(_person_nodes(page)):
        strings = page.strings(node)
        inner = [r for r in roles if node.start < r.start < node.end]
        blocks.append({
            "block_ord": i,
            "text": " ".join(strings),
            "html": html[node.start:node.end],
            "strings": strings,
            "role_texts": ["".join(page.strings(r)) for r in inner],
        })
    return blocks


@F.pandas_udf(BLOCK_TYPE)
def _cut_blocks(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda html: person_blocks_of(html) if html else None)


def may_hold_names(html: Column) -> Column:
    """Cheap test a page with a full name always passes: Cyrillic capitals and
    a patronymic ending, or character references that could hide both: by number, or
    by a name of a Cyrillic letter (all of these end in `cy`)."""
    return (html.rlike("[А-ЯЁ]") & html.rlike("ич|на")) | html.contains("&#") | html.rlike("&[A-Za-z]+cy;")


def person_blocks(html: Column) -> Column:
    """Blocks of the page in document order; pages without names skip Python."""
    return F.coalesce(_cut_blocks(F.when(may_hold_names(html), html)), F.array().cast(BLOCK_TYPE))
