"""HTML pages by their structure: a tree with what is left unclosed closed, and selectors on it.

A selector is a chain of ``tag.class#id[attribute=value]`` steps, each below
the one before.  A part of an element is a selector for its text, or
``selector@attribute``; ``selector:n`` is the n-th match from 0, and ``a >> b``
the first b within the first a.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Fixed values of HTML: elements without content, those whose text is none, and what a start tag closes up to which element.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
CELLS, ROWS, SECTIONS = frozenset(("td", "th")), frozenset(("td", "th", "tr")), frozenset(("td", "th", "tr", "tbody", "thead", "tfoot"))
CLOSES = {
    **dict.fromkeys(BLOCKS, (frozenset(("p",)), frozenset(("table", "td", "th", "body")))),
    **dict.fromkeys(CELLS, (CELLS, frozenset(("table",)))), "tr": (ROWS, frozenset(("table",))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (SECTIONS, frozenset(("table",)))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "table"))), "option": (frozenset(("option",)), frozenset(("select",))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl", "table")))),
}


class Element:
    """An element: its tag, attributes, the element above, and elements and texts below in order."""

    __slots__ = ("above", "attrs", "below", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], above: Element | None) -> None:
        self.tag, self.attrs, self.above, self.below = tag, attrs, above, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in the order of the document."""
        waiting = [x for x in reversed(self.below) if isinstance(x, Element)]
        while waiting:
            e = waiting.pop()
            yield e
            waiting.extend(x for x in reversed(e.below) if isinstance(x, Element))

    def text(self) -> str:
        """All texts below, each without the white space around it, put together."""
        out, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x.tag not in SILENT:
                waiting.extend(reversed(x.below))
        return "".join(out)


class _Builder(HTMLParser):
    """Builds the tree; with selectors, it keeps only what they find and gives (selector, position, element) to ``found`` when an element closes."""

    def __init__(self, selectors: list[Selector] | None = None, found: Callable[[int, int, Element], None] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open = [self.root]
        self.selectors, self.found = selectors, found
        self.counts = [0] * len(selectors or ())
        # By place in the open elements: what selectors found there.
        self.held: dict[int, list[tuple[int, int]]] = {}

    def _cut(self, k: int) -> None:
        """Close all elements from a place on."""
        for at in [x for x in self.held if x >= k] if self.held else ():
            for n, position in self.held.pop(at):
                self.found(n, position, self.open[at])
        del self.open[k:]

    def _begin(self, e: Element, stays: bool) -> None:
        """Note a new element, which is the last of the open ones if it stays open."""
        found = []
        for n, selector in enumerate(self.selectors or ()):
            if selector.matches(e, self.root):
                found.append((n, self.counts[n]))
                self.counts[n] += 1
        if self.held or self.selectors is None:
            self.open[-1].below.append(e)
        if stays:
            self.open.append(e)
            if found:
                self.held[len(self.open) - 1] = found
        else:
            for n, position in found:
                self.found(n, position, e)

    def rest(self) -> None:
        self._cut(1)

    def handle_starttag(self, tag, attrs):
        closes, until = CLOSES.get(tag, ((), ()))
        cut = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in until:
                break
            if self.open[k].tag in closes:
                cut = k
        if cut:
            self._cut(cut)
        self._begin(Element(tag, {k: v or "" for k, v in attrs}, self.open[-1]), tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._cut(k)
                return
            # A stray end tag does not reach out of its table.
            if self.open[k].tag == "table" and tag in SECTIONS:
                return

    def handle_data(self, data):
        if data and (self.held or self.selectors is None):
            self.open[-1].below.append(data)


# A comment, a doctype, a script or style, a start or an end tag, or text, as nearly all pages write them.
_VALUE = r"""(?:"[^"&]*"|'[^'&]*'|[\w./#:?-][\w./#:?=-]*)"""
_ATTRS = rf"(?:[ \t\n\r\f]+[a-zA-Z][\w-]*(?:={_VALUE})?)*"
_PLAIN = re.compile(
    rf"<!--(?!-?>)(?:(?!--).)*-->|<!(?i:doctype)[^>]*>|<(?P<raw>(?i:script|style))(?P<raw_attrs>{_ATTRS})[ \t\n\r\f]*>"
    rf"|<(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>{_ATTRS})[ \t\n\r\f]*/?>|</(?P<end>[a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|(?P<text>[^<]+)",
    re.DOTALL | re.ASCII,
)
_RAW_END = {tag: re.compile(rf"</{tag}[ \t\n\r\f]*>", re.IGNORECASE) for tag in ("script", "style")}
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""", re.ASCII)


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(text)] if text else []


def each_found(html: str | None, selectors: list[Selector], found: Callable[[int, int, Element], None]) -> None:
    """Give (number of a selector, position, element) of all that selectors find in a page, as elements close.

    Only what lies in a found element is kept, and no longer than it is open.
    Plain markup is read by one pattern; from the first that is not plain,
    HTMLParser reads on.
    """
    html, builder, at = html or "", _Builder(selectors, found), 0
    while at < len(html) and (m := _PLAIN.match(html, at)):
        nxt = m.end()
        if text := m["text"]:
            if builder.held:
                builder.handle_data(unescape(text))
        elif tag := m["tag"]:
            builder.handle_starttag(tag.lower(), _attributes(m["attrs"]))
        elif tag := m["end"]:
            builder.handle_endtag(tag.lower())
        elif tag := m["raw"]:
            end = _RAW_END[tag.lower()].search(html, nxt)
            if not end:
                break
            builder.handle_starttag(tag.lower(), _attributes(m["raw_attrs"]))
            builder.handle_endtag(tag.lower())
            nxt = end.end()
        at = nxt
    if at < len(html):
        builder.feed(html[at:])
        builder.close()
    builder.rest()


def tree(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_STEP = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


class Selector:
    """A parsed chain of steps."""

    def __init__(self, text: str) -> None:
        self.steps = []
        for step in text.split():
            if "".join(m[0] for m in _STEP.finditer(step)) != step:
                raise ValueError(f"{step} is no step of a selector")
            self.steps.append([m.groups() for m in _STEP.finditer(step)])
        if not self.steps:
            raise ValueError("a selector has at least one step")
        self.tags = {tag.lower() for tag, *_ in self.steps[-1] if tag}

    @staticmethod
    def _is(e: Element, step: list[tuple]) -> bool:
        for tag, cls, ident, attr, value in step:
            if tag and e.tag != tag.lower() or cls and cls not in e.attrs.get("class", "").split() or ident and e.attrs.get("id") != ident:
                return False
            if attr and (attr not in e.attrs or value is not None and e.attrs[attr] != value):
                return False
        return True

    def matches(self, e: Element, within: Element) -> bool:
        """Whether an element fits; the steps before the last may be anywhere above it, within the given one."""
        if self.tags and e.tag not in self.tags or not self._is(e, self.steps[-1]):
            return False
        k, up = len(self.steps) - 2, e.above
        while k >= 0 and up is not None and up is not within:
            if self._is(up, self.steps[k]):
                k -= 1
            up = up.above
        return k < 0

    def all(self, within: Element) -> Iterator[Element]:
        return (e for e in within.walk() if self.matches(e, within))


class Part:
    """What to take of an element."""

    def __init__(self, text: str) -> None:
        chain, _, self.attribute = text.partition("@")
        self.steps = []
        for piece in chain.split(">>"):
            m = re.fullmatch(r"\s*(.*?)(?::(\d+))?\s*", piece)
            self.steps.append((Selector(m[1]), int(m[2] or 0)) if m[1] else None)

    def of(self, e: Element) -> str | None:
        for step in self.steps:
            if step:
                selector, n = step
                e = next((x for k, x in enumerate(selector.all(e)) if k == n), None)
                if e is None:
                    return None
        return e.attrs.get(self.attribute) if self.attribute else e.text()


#: Rows of a batch of elements found.
ROWS_AT_ONCE = 5000


def selected_each(pages: DataFrame, wanted: list[tuple[str, dict[str, str]]], id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, which, position, parts...) of what several selectors find, each page read once; ``which`` is the selector's number from 0.

    Parts of one name share a column; a part that a selector does not take is
    null.  A null page has no elements; whatever is broken in a page is read
    as far as it can be.
    """
    source = pages.select(id_col, html)
    names = list(dict.fromkeys(p for _, parts in wanted for p in parts))
    integer = T.IntegerType()
    schema = T.StructType([source.schema.fields[0], T.StructField("which", integer), T.StructField("position", integer), *(T.StructField(p, T.StringType()) for p in names)])
    arrow = to_arrow_schema(schema)
    selectors = [Selector(s) for s, _ in wanted]
    taken = [[Part(parts[p]) if p in parts else None for p in names] for _, parts in wanted]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for page, text in zip(batch[0], batch[1], strict=True):
                key = page.as_py()
                each_found(text.as_py(), selectors, lambda n, k, e, key=key: rows.append((key, n, k, *(p and p.of(e) for p in taken[n]))))
                while len(rows) >= ROWS_AT_ONCE:
                    yield batch_of(rows[:ROWS_AT_ONCE])
                    del rows[:ROWS_AT_ONCE]
        if rows:
            yield batch_of(rows)

    return source.mapInArrow(read, schema)


def selected(pages: DataFrame, selector: str, parts: dict[str, str], id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, position, parts...) of every element of every page that a selector finds; a part that is not there is null."""
    return selected_each(pages, [(selector, parts)], id_col, html).drop("which")
