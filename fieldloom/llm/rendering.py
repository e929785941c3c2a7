"""Visible text of HTML pages, laid out: blocks, lists and aligned tables.

A tree builder closes and opens what authors leave out (``</p>``, ``</li>``, ``<tr>`` ...),
visibility rules drop what a browser would not show, and a renderer writes the rest as
lines: margins become blank lines, list items get markers and indents, table cells stand
in columns. No visible text is judged or dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldloom.llm.common import text, with_result

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head script style template noscript title iframe object audio video canvas svg math datalist"
    " noframes noembed meta link base param source track area map dialog".split()
)
"""Elements whose content a page does not show as text (a dialog only while it is open)."""
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary"
    " table caption thead tbody tfoot tr td th ul search option optgroup".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu dir fieldset".split())
"""Blocks with a margin: a blank line before and behind."""
KEEPS_SPACE = frozenset(("pre", "textarea", "listing", "xmp"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("html body option optgroup legend td th tr thead tbody tfoot caption".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "optgroup": {"optgroup"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "tr": {"tr", "tbody", "thead", "tfoot"},
    "thead": {"tbody", "tfoot", "thead"}, "tbody": {"tbody", "tfoot", "thead"}, "tfoot": {"tbody", "tfoot", "thead"},
    "caption": {"tr", "td", "th", "tbody", "thead", "tfoot"},
}
"""An open element is ended by the start of one of these inside the same container."""
SCOPE = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"},
    "optgroup": {"select"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"},
    "tbody": {"table"}, "tfoot": {"table"}, "caption": {"table"},
}
MOST_INDENT = 80
"""Lines that are indented this far are not moved further in by what contains them."""
ALIGN = 40
"""Widest column that is padded; longer cells run over and the row goes on behind them."""
GAP = "  "
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SHOWN = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible\b", re.I)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Tree of a page; ``root`` stands for the document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.held = Counter()  # open elements by tag

    def _cut(self, i: int) -> None:
        self.held.subtract(n.tag for n in self.open[i:])
        del self.open[i:]

    def _close(self, tags: frozenset[str] | set[str], scope: set[str]) -> None:
        """End the nearest open element of ``tags``, unless a ``scope`` element is nearer."""
        if not any(self.held[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in scope:
                return

    def _imply(self, tag: str) -> None:
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        for old in {t for t, by in CLOSED_BY.items() if tag in by}:
            self._close({old}, SCOPE[old] | ({"table"} if old not in SCOPE["td"] else set()))
        # rows and cells stand inside a table and a row, written or not
        if tag in ("td", "th"):
            self._within("tr", {"table"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(-1)

    def _within(self, tag: str, scope: set[str]) -> None:
        for node in reversed(self.open):
            if node.tag == tag:
                return
            if node.tag in scope:
                self._push(tag, {})
                return

    def _push(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.held[tag] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") or tag == "head" and len(self.open) > 1:
            if tag == "body":
                self._close({"head"}, set())
            for k, v in attrs:
                self.root.attrs.setdefault(k, v)
            return
        if len(self.open) > 1 and self.open[-1].tag == "head" and tag not in UNSEEN:
            self._cut(-1)  # the body begins without a tag
        self._imply(tag)
        self._push(tag, dict(attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends no element in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in VOID:
            return
        if tag == "p" and not self.held["p"]:
            self._push("p", {})
        if tag in HEADINGS:  # the end of any heading ends the open one
            return self._close(HEADINGS, {"table", "td", "th"})
        inline = tag not in BLOCK and tag not in UNSEEN
        walls = {"td", "th", "table", "caption"} if inline or tag == "p" else {"table"} if tag in SCOPE else set()
        self._close({tag}, walls - {tag})

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "head" and data.strip():
            self._cut(-1)
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    """Whether a page shows the element at all."""
    a = node.attrs
    if node.tag in UNSEEN:
        return node.tag == "dialog" and "open" in a
    if "hidden" in a and (a["hidden"] or "").lower() != "until-found":
        return False
    return not (a.get("style") and _HIDDEN.search(a["style"]) and not _SHOWN.search(a["style"]))


class Page:
    """Lines of a block and of what it contains."""

    def __init__(self, pre: bool = False):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = True  # the line so far ends in a blank or is empty
        self.margin = False
        self.pre = pre

    def write(self, data: str) -> None:
        if self.pre:
            first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._add(first)
            for s in rest:
                self.end(force=True)
                self._add(s)
            return
        s = _SPACE.sub(" ", data)
        if self.blank and s.startswith(" "):
            s = s[1:]
        self._add(s)

    def _add(self, s: str) -> None:
        if s:
            self.line.append(s)
            self.blank = s.endswith(" ")

    def end(self, force: bool = False) -> None:
        """Finish the current line; an empty one only if ``force``."""
        s = "".join(self.line).rstrip(" \t\n\f")
        self.line, self.blank = [], True
        if s or force:
            self._emit(s)

    def _emit(self, s: str) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        self.lines.append(s)

    def space(self) -> None:
        self.end()
        self.margin = True

    def take(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Add the lines of a finished block behind a marker or indent."""
        self.end()
        for i, s in enumerate(lines):
            before = first if i == 0 else rest if len(s) - len(s.lstrip(" ")) < MOST_INDENT else ""
            self._emit((before + s).rstrip() if s else "")


def walked(task: Generator) -> list[str]:
    """Run ``block`` and what it yields: each generator is given the result of the one that it
    asks for. The stack is a list, so pages may nest as deep as they like."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def block(node: Node, pre: bool = False) -> Generator:
    """Lines of what ``node`` contains."""
    page = Page(pre)
    yield fill(page, node)
    page.end()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    while page.lines and not page.lines[0]:
        page.lines.pop(0)
    return page.lines


def fill(page: Page, node: Node) -> Generator:
    """Write what ``node`` contains, in order."""
    ordered = node.tag == "ol"
    start = node.attrs.get("start") or ""
    number = int(start) if ordered and re.fullmatch(r"-?\d{1,9}", start) else 1
    shut = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if not shut and (page.pre or node.tag not in ("table", "tr", "ul", "ol") or child.strip()):
                page.write(child)
            continue
        tag = child.tag
        if not visible(child) or shut and tag != "summary":
            continue
        if tag == "br":
            page.end(force=True)
        elif tag == "hr":
            page.space()
        elif tag in ("img", "input"):
            if tag == "input" and (child.attrs.get("type") or "").lower() in ("submit", "button", "reset"):
                page.write(f" {child.attrs.get('value') or ''} ")
        elif tag == "li":
            marker = f"{number}. " if ordered else "- "
            number += 1
            page.take((yield block(child, page.pre)), marker, " " * len(marker))
        elif tag == "dd" or tag == "blockquote":
            page.space() if tag == "blockquote" else None
            page.take((yield block(child, page.pre)), GAP, GAP)
            page.space() if tag == "blockquote" else None
        elif tag == "table":
            page.space()
            page.take((yield table(child)))
            page.space()
        elif tag in KEEPS_SPACE:
            page.space() if tag == "pre" else page.end()
            page.take((yield block(child, True)))
            page.space() if tag == "pre" else page.end()
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and node.tag == "li"
            edge = page.space if tag in SPACED and not nested else page.end
            edge()
            yield fill(page, child)
            edge()
        else:
            yield fill(page, child)


def rows_of(node: Node) -> tuple[Node, list[Node]]:
    """(captions and loose content, rows) of a table, row groups opened up."""
    loose, rows = Node("div", {}), []
    ahead = list(reversed(node.children))
    while ahead:
        child = ahead.pop()
        if isinstance(child, str):
            if child.strip():
                loose.children.append(child)
        elif not visible(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            ahead += reversed(child.children)
        elif child.tag == "tr":
            rows.append(child)
        elif child.tag not in ("colgroup", "col"):
            loose.children.append(child)
    return loose, rows


def span(cell: Node, name: str, most: int) -> int:
    value = (cell.attrs.get(name) or "").strip()
    return min(max(int(value), 1), most) if re.fullmatch(r"\d{1,9}", value) else 1


def table(node: Node) -> Generator:
    """Lines of a table: cells of a column begin at the same place where they fit ALIGN."""
    loose, rows = rows_of(node)
    grid: list[list[tuple[int, list[str]]]] = []
    busy: dict[int, int] = {}  # column: rows it stays taken by a cell from above
    width: dict[int, int] = {}
    for row in rows:
        cells, column, taken = [], 0, {}
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                cell, stray = Node("td", {}), cell
                cell.children.append(stray)
            elif not visible(cell):
                continue
            while busy.get(column, 0) > 0:
                column += 1
            lines = yield block(cell if cell.tag in ("td", "th") else _wrap(cell))
            wide = span(cell, "colspan", 1000)
            cells.append((column, lines))
            if wide == 1:
                longest = max(map(len, lines), default=0)
                width[column] = max(width.get(column, 0), min(longest, ALIGN))
            high = span(cell, "rowspan", 65534)
            if high > 1:
                taken.update(dict.fromkeys(range(column, column + wide), high))
            column += wide
        busy = {c: n - 1 for c, n in {**busy, **taken}.items() if n > 1}
        grid.append(cells)
    columns = sorted(width)
    place, at = {}, 0
    for c in columns:
        place[c] = at
        at += width[c] + len(GAP)
    out = yield block(loose)
    for cells in grid:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            s = ""
            for c, lines in cells:
                if i < len(lines) and lines[i]:
                    s = s.rstrip()
                    s = s.ljust(place.get(c, 0)) if len(s) + len(GAP) <= place.get(c, 0) or not s else s + GAP
                    s += lines[i]
            out.append(s.rstrip())
    return out


def _wrap(cell: Node) -> Node:
    holder = Node("td", {})
    holder.children.append(cell)
    return holder


def title_of(node: Node) -> str:
    for child in node.children:
        if isinstance(child, Node):
            if child.tag == "title":
                return _SPACE.sub(" ", "".join(c for c in child.children if isinstance(c, str))).strip()
            if child.tag == "head" and (found := title_of(child)):
                return found
    return ""


def render(html: str) -> tuple[str, str]:
    """(title, visible text)."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    lines = walked(block(builder.root))
    return title_of(builder.root), "\n".join(lines).replace("\xa0", " ")


RESULT = StructType(
    [StructField("title", StringType()), StructField("text", StringType())]
    + [StructField(c, LongType()) for c in ("n_chars", "n_lines")]
)


@F.arrow_udf(RESULT)
def _render(pages: pa.Array) -> pa.Array:
    found = [render(s.as_py() or "") for s in pages]
    return pa.StructArray.from_arrays(
        [
            pa.array([t for t, _ in found], pa.string()),
            pa.array([s for _, s in found], pa.string()),
            pa.array([len(s) for _, s in found], pa.int64()),
            pa.array([s.count("\n") + 1 if s else 0 for _, s in found], pa.int64()),
        ],
        names=RESULT.names,
    )


def render_column(col: str | Column = "html") -> Column:
    return _render(text(col))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, title, text, n_chars, n_lines): one row per row of ``pages``.

    A null or empty page, and one that shows nothing, has an empty title and text. Pages
    are independent: ids may be null or repeat, other columns are ignored.
    """
    got, name = with_result(pages.select(id_col, html_col), render_column(html_col), "page")
    return got.select(id_col, f"{name}.*")
