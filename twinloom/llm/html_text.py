"""Visible text of web pages, laid out as blocks, lists and tables.

A tree builder supplies the tags that HTML lets authors leave out; rules of visibility drop what a
browser would not show; a writer lays the rest out. All visible text is kept, boilerplate too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import slices

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template title noscript datalist iframe noembed noframes audio video canvas object "
    "rp".split()
)
# Not painted inside drawings and formulas; elsewhere these are tags like any other.
FOREIGN = ("svg", "math")
FOREIGN_HIDDEN = frozenset(
    "annotation annotation-xml mphantom defs symbol title desc metadata clippath mask pattern marker".split()
)
# Drawn at places of their own.
APART = frozenset("text mtr mtd".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl pre blockquote table figure xmp".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form "
    "header hgroup hr legend li main nav optgroup option search section summary tr td th thead tbody tfoot "
    "caption".split()
)
# An opening tag closes these, if they are open before any of the tags that shield them.
ENDS_P = BLOCKS - frozenset("html body li dd dt td th tr thead tbody tfoot caption option optgroup legend summary".split())
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Content that cannot stand in the head: it ends the head and begins the body.
HEAD_ONLY = frozenset("base link meta title style script template noscript head html".split())
SHIELDS_P = ("td", "th", "caption", "button", "object", "table", "html")
# Deeper elements join this level, as in browsers; their text stays.
DEEPEST = 200

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []

    def shown(self) -> bool:
        if self.tag in HIDDEN or "hidden" in self.attrs:
            return False
        if self.tag == "dialog" and "open" not in self.attrs:
            return False
        return not ("style" in self.attrs and _NOT_SHOWN.search(self.attrs["style"]))

    def number(self, name: str, default: int) -> int:
        try:
            return int(self.attrs.get(name, default))
        except ValueError:
            return default


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /\t\n"):
        return {}
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return found


class TreeBuilder:
    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...], shields: tuple[str, ...]) -> None:
        """Close the outermost of ``tags`` above the nearest shield."""
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in shields:
                break
            if self.open[i].tag in tags:
                at = i
        if at is not None:
            del self.open[at:]

    def _body(self, tag: str) -> None:
        if tag not in HEAD_ONLY and self.open[-1].tag == "head":
            self.open.pop()

    def foreign(self) -> bool:
        """Whether a drawing or formula is open, and no HTML inside it."""
        for node in reversed(self.open):
            if node.tag in FOREIGN or node.tag == "foreignobject":
                return node.tag != "foreignobject"
        return False

    def start(self, tag: str, attrs: dict[str, str], alone: bool = False) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        self._body(tag)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in ENDS_P:
            self._close(("p",), SHIELDS_P)
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
        parent = self.open[-1].tag
        if tag in ("td", "th") and parent in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {})
        if tag in FOREIGN_HIDDEN and self.foreign():
            attrs = attrs | {"hidden": ""}
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if not alone and tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.start("p", {})
        if tag in ("html", "body"):
            return
        shields = () if tag == "table" else ("table",) if tag in ("tr", "tbody", "thead", "tfoot") else ("td", "th", "table")
        if tag in ("td", "th"):
            shields = ("tr", "table")
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in shields:
                return

    def text(self, text: str) -> None:
        if text:
            if not text.isspace():
                self._body("")
            self.open[-1].children.append(text)


def parse(html: str) -> Node:
    builder, at = TreeBuilder(), 0
    match = _TOKEN.search(html)
    while match:
        builder.text(unescape(html[at : match.start()]))
        at, tag = match.end(), match["tag"]
        if tag:
            tag = tag.lower()
            if match["end"]:
                builder.end(tag)
            else:
                # Only foreign elements can end themselves.
                alone = match["attrs"].endswith("/") and (tag in FOREIGN or builder.foreign())
                builder.start(tag, _attributes(match["attrs"]), alone)
                if tag in RAW and not alone:
                    stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                    end = stop.start() if stop else len(html)
                    raw = html[at:end]
                    builder.text(unescape(raw) if tag in ("textarea", "title") else raw)
                    builder.end(tag)
                    at = end
        match = _TOKEN.search(html, at)
    # A "<" that begins no tag is text.
    builder.text(unescape(html[at:]))
    return builder.root


class Writer:
    """Collects lines; blanks between blocks are asked for and never doubled."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.space = False
        self.indent = ""
        self.mark = ""

    def word(self, text: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def inline(self, text: str) -> None:
        parts = _SPACES.sub(" ", text)
        if parts[:1] == " ":
            self.space = bool(self.line)
        body = parts.strip(" ")
        if body:
            self.word(body)
            self.space = parts[-1:] == " "

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.newline()
        self.gap = self.gap or spaced

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.expandtabs(8).split("\n")):
            if i:
                if not self.line:
                    self.word("")
                self.newline()
            if line:
                self.word(line)


def _render(node: Node, out: Writer, depth: int, pre: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.verbatim(child.replace("\r\n", "\n")) if pre else out.inline(child)
        elif child.shown():
            _element(child, out, depth, pre)


def _element(node: Node, out: Writer, depth: int, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        if not out.line and out.lines and not out.gap:
            out.gap = True
        out.newline()
    elif tag == "img":
        if node.attrs.get("alt"):
            out.inline(node.attrs["alt"])
    elif tag == "input":
        if node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
            out.inline(" " + node.attrs["value"] + " ")
    elif tag == "select":
        _select(node, out, depth)
    elif tag in APART:
        out.space = out.space or bool(out.line)
        _render(node, out, depth, pre)
        out.space = bool(out.line)
    elif tag == "table":
        out.block(True)
        _table(node, out, depth)
        out.block(True)
    elif tag in ("ul", "ol", "menu"):
        out.block(depth == 0)
        _list(node, out, depth)
        out.block(depth == 0)
    elif tag in BLOCKS:
        spaced = tag in SPACED and not (depth and tag == "p")
        out.block(spaced)
        if tag in ("blockquote", "dd"):
            out.indent += "  "
        _render(node, out, depth, pre or tag in ("pre", "textarea", "xmp"))
        out.newline()
        if tag in ("blockquote", "dd"):
            out.indent = out.indent[:-2]
        out.block(spaced)
    else:
        _render(node, out, depth, pre or tag == "textarea")


def _options(node: Node) -> Iterable[Node]:
    for child in node.children:
        if isinstance(child, Node) and child.shown():
            if child.tag == "option":
                yield child
            else:
                yield from _options(child)


def _select(node: Node, out: Writer, depth: int) -> None:
    """All options of a list box; of a menu the last that is marked as selected, or else the first one allowed."""
    if "multiple" in node.attrs or node.number("size", 1) > 1:
        _render(node, out, depth, False)
        return
    options = list(_options(node))
    marked = [o for o in options if "selected" in o.attrs][-1:]
    for option in marked or [o for o in options if "disabled" not in o.attrs][:1]:
        out.space = out.space or bool(out.line)
        _render(option, out, depth, False)
        out.space = bool(out.line)


def _list(node: Node, out: Writer, depth: int) -> None:
    number = node.number("start", 1)
    for child in node.children:
        if isinstance(child, str):
            out.inline(child)
        elif not child.shown():
            continue
        elif child.tag == "li":
            number = child.number("value", number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            out.newline()
            before, out.indent = out.indent, out.indent + " " * len(mark)
            out.mark = mark
            _render(child, out, depth + 1, False)
            out.newline()
            out.indent, out.mark = before, ""
        else:
            _element(child, out, depth, False)


def _rows(node: Node) -> Iterable[Node]:
    for child in node.children:
        if isinstance(child, Node) and child.shown():
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def _loose(node: Node) -> Iterable[Node | str]:
    """What stands in a table but in no row: captions and stray content."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield child
        elif child.shown():
            if child.tag in ("thead", "tbody", "tfoot", "tr"):
                yield from (c for c in _loose(child) if isinstance(c, str) or c.tag not in ("td", "th"))
            else:
                yield child


def _table(node: Node, out: Writer, depth: int) -> None:
    for item in _loose(node):
        if isinstance(item, str):
            out.inline(item)
        else:
            _element(item, out, depth, False)
    out.newline()
    grid: list[list[tuple[int, str]]] = []
    below: dict[int, int] = {}
    widths: dict[int, int] = {}
    for row in _rows(node):
        cells, column = [], 0
        for cell in row.children:
            if isinstance(cell, str) or not cell.shown() or cell.tag not in ("td", "th"):
                continue
            while below.get(column, 0):
                below[column] -= 1
                column += 1
            inner = Writer()
            _render(cell, inner, 0, False)
            inner.newline()
            text = " ".join(line.strip() for line in inner.lines if line.strip())
            span = min(max(cell.number("colspan", 1), 1), 1000)
            cells.append((column, text))
            if span == 1:
                widths[column] = max(widths.get(column, 0), len(text))
            for c in range(column, column + span):
                below[c] = min(max(cell.number("rowspan", 1), 1), 65534) - 1
            column += span
        for c in below:
            if c >= column and below[c]:
                below[c] -= 1
        grid.append(cells)
    starts, at = {}, 0
    for column in range(max(widths, default=-1) + 1):
        starts[column] = at
        at += widths.get(column, 0) + 2 * (column in widths)
    for cells in grid:
        line = ""
        for column, text in cells:
            if text:
                line = (line + "  " if line else "").ljust(starts.get(column, 0)) + text
        if line:
            out.newline()
            out.word(line)
    out.newline()


def render(html: str) -> str:
    """Visible text of a page; empty for an empty page."""
    out = Writer()
    root = parse(html)
    if root.shown():
        _render(root, out, 0, False)
    out.newline()
    return "\n".join(out.lines)


def _rendered(batches: Iterable[pa.RecordBatch]):
    for batch in slices(batches, 500):
        texts = [render(h) if h else "" for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id`` and ``text`` of each page.

    A missing or empty page gives an empty text, as does one without visible text. Broken or cut
    off pages are read as browsers would. Repeated rows repeat; other columns are not read.
    """
    source = pages.select("page_id", F.col("html"))
    schema = T.StructType([source.schema["page_id"], T.StructField("text", T.StringType())])
    return source.mapInArrow(_rendered, schema)
