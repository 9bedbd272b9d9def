"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware renderer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import map_batches, table
from .html_tree import Node, TreeBuilder

#: Elements that show nothing of their own, in a browser that runs scripts and plays media, but loads no plug-in.
UNSEEN = frozenset("script style noscript template head title iframe audio video datalist noembed noframes rp progress meter param source track".split())
#: Parts of svg and math that hold definitions and descriptions.
UNSEEN_FOREIGN = frozenset("title desc metadata defs symbol style script clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
#: Blocks with an empty line on either side.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dir dl pre listing xmp plaintext blockquote table figure".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
PREFORMATTED = frozenset(("pre", "listing", "xmp", "plaintext", "textarea"))
BLOCK_DISPLAY = frozenset("block list-item table flex grid flow-root".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
#: Columns up to which lines are indented and cells aligned; what lies beyond follows two spaces later. It bounds the spaces
#: that a page can make of its tags, and never drops text.
MOST_INDENT, MOST_ALIGNED = 64, 400
#: Tables nested deeper are written as lines, not as grids.
MOST_NESTED = 8
#: Fixed values of the HTML standard: a cell spans at most so many columns and rows.
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534


def style_of(node: Node) -> dict[str, str]:
    """The element's own style: property -> value, in lower case; important declarations, then later ones, win."""
    found: dict[str, tuple[bool, str]] = {}
    for part in CSS_COMMENT.sub("", node.attrs.get("style", "")).split(";"):
        name, _, value = part.partition(":")
        value, important = value.strip().lower(), False
        if value.endswith("important") and value.removesuffix("important").rstrip().endswith("!"):
            value, important = value.removesuffix("important").rstrip()[:-1].strip(), True
        name = name.strip().lower()
        if value and (important or not found.get(name, (False, ""))[0]):
            found[name] = important, value
    return {k: v for k, (_, v) in found.items()}


def removed(node: Node, style: dict[str, str]) -> bool:
    """Whether an element and all in it take no part: by its kind, an attribute, or its style."""
    tag, attrs = node.tag, node.attrs
    if tag in (UNSEEN_FOREIGN if node.foreign else UNSEEN):
        return True
    if tag == "input":
        return (attrs.get("type") or "").lower() not in ("submit", "button", "reset") or "hidden" in attrs or style.get("display") == "none"
    if style.get("display") == "none" or style.get("content-visibility") == "hidden":
        return True
    by_attribute = "hidden" in attrs or "popover" in attrs or (tag == "dialog" and "open" not in attrs)
    return by_attribute and "display" not in style


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines with collapsed white space; a block break ends the line, a gap leaves one empty line.

    Levels of indentation lie on a stack; a level's mark stands before its first line, and spaces before the others.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.indent = 0  # of the levels that have a line
        self.levels: list[str] = []  # the marks
        self.waiting = 0  # so many innermost levels have no line yet

    def enter(self, mark: str) -> None:
        self.levels.append(mark)
        self.waiting += 1

    def leave(self) -> None:
        mark = self.levels.pop()
        if self.waiting:
            self.waiting -= 1
        else:
            self.indent -= len(mark)

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *more = data.split("\n")
            self._put(first)
            for line in more:
                self._end(True)
                self._put(line)
            return
        words = SPACE.sub(" ", data)
        if words.strip(" "):
            if (words[0] == " " or self.space) and self.parts:
                self.parts.append(" ")
            self._put(words.strip(" "))
            self.space = words[-1] == " "
        elif words:
            self.space = True

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.parts:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            if self.indent:
                self.parts.append(" " * min(self.indent, MOST_INDENT))
            if self.waiting:
                marks = self.levels[-self.waiting :]
                self.parts += marks
                self.indent += sum(map(len, marks))
                self.waiting = 0
        self.gap = False
        self.parts.append(text)

    def _end(self, always: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line or always:
            self.lines.append(line)
        self.parts, self.space = [], False

    def line(self) -> None:
        """A line break."""
        self._end(True)

    def block(self, gap: bool) -> None:
        self._end()
        self.gap |= gap

    def put_lines(self, lines: list[str]) -> None:
        """Whole lines, as they are."""
        self._end()
        for line in lines:
            self._put(line)
            self._end(True)

    def done(self) -> list[str]:
        self._end()
        first, last = 0, len(self.lines)
        while last > first and not self.lines[last - 1]:
            last -= 1
        while first < last and not self.lines[first]:
            first += 1
        return self.lines[first:last]


class _Table:
    """Cells of a table by row; head and foot groups go first and last wherever they stand."""

    def __init__(self):
        self.groups: list[tuple[int, list]] = []  # (0 head, 1 body or 2 foot, rows)
        self.seen: set[int] = set()

    def group(self, tag: str) -> None:
        kind = {"thead": 0, "tfoot": 2}.get(tag, 1)
        kind = 1 if kind in self.seen and kind != 1 else kind
        self.seen.add(kind)
        self.groups.append((kind, []))

    def row(self) -> None:
        if not self.groups:
            self.group("tbody")
        self.groups[-1][1].append([])

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.groups or not self.groups[-1][1]:
            self.row()
        self.groups[-1][1][-1].append((lines, columns, rows))

    def laid(self) -> list[list[tuple[int, int, list[str]]]]:
        """Rows of (first column, end column, lines): each cell takes the first place that no cell from a row above still takes."""
        out = []
        for _, rows in sorted(self.groups, key=lambda g: g[0]):
            taken: list[tuple[int, int, int]] = []  # (first column, end column, end row) by column
            for r, row in enumerate(rows):
                if not row:
                    continue
                taken = [t for t in taken if t[2] > r]
                at, k, placed, more = 0, 0, [], []
                for lines, columns, span in row:
                    while k < len(taken) and taken[k][0] <= at:
                        at, k = max(at, taken[k][1]), k + 1
                    placed.append((at, at + columns, lines))
                    if span != 1:
                        more.append((at, at + columns, r + span if span else len(rows)))
                    at += columns
                if more:
                    taken = sorted(taken + more)[: MOST_ALIGNED // 2]  # further ones start beyond the columns that are aligned
                out.append(placed)
        return out


def _grid(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of cells as lines. A column starts two places after the widest line of every cell that ends before it."""
    rows = [r for r in rows if any(lines for _, _, lines in r)]
    starts = sorted({a for r in rows for a, _, _ in r})
    ends: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        for a, b, lines in r:
            ends.setdefault(b, []).append((a, max(map(width, lines), default=0)))
    at: dict[int, int] = {}
    before, stops = 0, sorted(ends)
    k = 0
    for s in starts:
        while k < len(stops) and stops[k] <= s:
            before = max(before, *(at[a] + w + 2 for a, w in ends[stops[k]]))
            k += 1
        at[s] = before = min(before, MOST_ALIGNED)
    out = []
    for r in rows:
        lines = [(a, x) for a, _, x in r if x]
        for k in range(max(len(x) for _, x in lines)):
            parts, used = [], 0
            for a, x in lines:
                if k < len(x) and x[k]:
                    room = max(at[a] - used, 2 if used else 0)
                    parts += [" " * room, x[k]]
                    used += room + width(x[k])
            out.append("".join(parts).rstrip(" "))
    return out


def _number(text: str | None, low: int, high: int, default: int) -> int:
    found = re.match(r"[ \t\n\f]*([+-]?[0-9]{1,12})", text or "")
    return max(low, min(high, int(found[1]))) if found else default


def _mark(value: int, kind: str) -> str:
    """An item's number in the style of its list's type."""
    if kind in ("a", "A") and value > 0:
        made = ""
        while value:
            value, digit = divmod(value - 1, 26)
            made = chr(97 + digit) + made
    elif kind in ("i", "I") and 0 < value < 4000:
        made = ""
        for n, letters in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            made += letters * (value // n)
            value %= n
    else:
        return str(value)
    return made.upper() if kind.isupper() else made


def _plain(node: Node) -> str:
    """All text in an element."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.tag not in UNSEEN:
            todo += reversed(x.children)
    return SPACE.sub(" ", "".join(out)).strip(" ")


def _options(select: Node) -> list[str]:
    """What a select shows: all options of a list box, the chosen or else the first one of a menu."""
    found: list[tuple[Node | None, str]] = []
    for child in select.children:
        if isinstance(child, str):
            continue
        if child.tag == "optgroup":
            found.append((None, child.attrs.get("label", "")))
            found += [(x, x.attrs.get("label") or _plain(x)) for x in child.children if not isinstance(x, str) and x.tag == "option"]
        elif child.tag == "option":
            found.append((child, child.attrs.get("label") or _plain(child)))
    found = [f for f in found if f[0] is None or not removed(f[0], style_of(f[0]))]
    if "multiple" in select.attrs or _number(select.attrs.get("size"), 0, 1 << 30, 1) > 1:
        return [label for _, label in found if label]
    own = [f for f in found if f[0] is not None]
    chosen = [f for f in own if "selected" in f[0].attrs] or [f for f in own if "disabled" not in f[0].attrs][:1]
    return [label for _, label in chosen[-1:] if label]


def render(root: Node) -> list[str]:
    """Lines of all visible text. Walks with an own stack, so depth is no limit.

    Lists are marked (`- `, or the number), nested ones and quotes are indented, table cells are padded to their column.
    """
    page = _Page()
    pages, tables = [page], []  # a cell, and what stands in no cell of a table, has its own page
    counters: list[list] = []  # of the open lists: next number, step, type; None for unnumbered ones
    # Steps: enter a node with (preformatted, shown, text of an svg shows); or leave it with what entering opened.
    stack: list[tuple] = [(root, (False, True, True), None)]
    while stack:
        node, state, opened = stack.pop()
        page = pages[-1]
        if isinstance(node, str):
            if state[1] and state[2]:
                page.text(node, state[0])
            elif node.strip(" \t\n\f") != node or not node.strip(" \t\n\f"):
                page.text(" ", False)
            continue
        tag = node.tag
        if opened is not None:
            _leave(node, opened, pages, tables, counters)
            continue
        style = style_of(node) if "style" in node.attrs else {}
        if removed(node, style):
            continue
        keep, shown, drawn = state
        if "visibility" in style:
            shown = style["visibility"] in ("visible", "initial") or (shown and style["visibility"] not in ("hidden", "collapse"))
        if tag == "br":
            page.line()
            continue
        if tag == "hr":
            page.block(True)
            continue
        if tag in ("img", "input"):
            text = node.attrs.get("alt" if tag == "img" else "value")
            if text and shown:
                page.text(text, False)
            continue
        if tag == "select":
            labels = _options(node) if shown else []
            for k, label in enumerate(labels):
                if len(labels) > 1:
                    page.block(False)
                page.text(label, False)
            if len(labels) > 1:
                page.block(False)
            continue
        keep = keep or (tag in PREFORMATTED and not node.foreign)
        if "white-space" in style:
            keep = style["white-space"].startswith("pre") or style["white-space"] == "break-spaces"
        if node.foreign:
            drawn = tag in ("text", "foreignobject") or (drawn and tag != "svg")
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        cell = tag in ("td", "th") and bool(tables)
        block = (tag in BLOCK and not node.foreign) or (node.foreign and tag in ("text", "mtr", "foreignobject", "svg"))
        if "display" in style and not node.foreign and tag not in LISTS | {"li", "table", "tr", "td", "th", "caption"}:
            block = style["display"] in BLOCK_DISPLAY or (block and style["display"] not in ("inline", "inline-block", "contents"))
        block = block and not cell and not (tag in ("tr", "tbody", "thead", "tfoot") and tables)
        gap = block and tag in SPACED and not (tag in ("ul", "ol", "dir") and bool(counters))
        opened = (block, gap, None)
        if block:
            page.block(gap)
        if node.foreign and tag == "mtd":
            page.text(" ", False)
        if tag in LISTS:
            counters.append(_counter(node))
            opened = (block, gap, "list")
        elif tag == "li":
            page.enter(_item_mark(node, counters))
            opened = (block, gap, "level")
        elif tag in ("blockquote", "dd"):
            page.enter("  ")
            opened = (block, gap, "level")
        elif tag == "table":
            if len(tables) < MOST_NESTED:
                tables.append(_Table())
                pages.append(_Page())
                opened = (block, gap, "table")
            else:
                tables.append(None)
                opened = (block, gap, "flat")
        elif tables and tables[-1] is None and tag in ("tr", "td", "th"):
            page.block(False)
        elif tag in ("tbody", "thead", "tfoot") and tables and tables[-1]:
            tables[-1].group(tag)
        elif tag == "tr" and tables:
            tables[-1].row()
        elif cell:
            pages.append(_Page())
            opened = (block, gap, "cell")
        stack.append((node, state, opened))
        inner = (keep, shown, drawn)
        stack += [(child, inner, None) for child in reversed(children)]
    return pages[0].done()


def _leave(node: Node, opened: tuple, pages: list[_Page], tables: list, counters: list) -> None:
    block, gap, kind = opened
    page = pages[-1]
    if kind == "list":
        counters.pop()
    elif kind == "level":
        page.block(False)
        page.leave()
    elif kind == "cell":
        rows = _number(node.attrs.get("rowspan"), 0, MOST_ROWSPAN, 1)
        tables[-1].cell(pages.pop().done(), max(1, _number(node.attrs.get("colspan"), 0, MOST_COLSPAN, 1)), rows)
    elif kind == "table":
        around = pages.pop().done()  # a caption, and what stands in no cell
        pages[-1].put_lines(around + _grid(tables.pop().laid()))
    elif kind == "flat":
        tables.pop()
    if block:
        pages[-1].block(gap)


def _counter(node: Node) -> list | None:
    if node.tag != "ol":
        return None
    down = "reversed" in node.attrs
    items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children)
    return [_number(node.attrs.get("start"), -(10**9), 10**9, items if down else 1), -1 if down else 1, node.attrs.get("type", "1")]


def _item_mark(node: Node, counters: list) -> str:
    if not counters or counters[-1] is None:
        return "- "
    counter = counters[-1]
    value = _number(node.attrs.get("value"), -(10**9), 10**9, counter[0])
    counter[0] = value + counter[1]
    return f"{_mark(value, counter[2])}. "


def extract(html: str | None) -> str:
    """All visible text of a page; a null or empty page gives an empty text."""
    return "\n".join(render(TreeBuilder(html).root)) if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, html, ...) -> (page_id, text, n_chars, n_lines), a row for each row.

    Whole pages are read, in time linear in them; other columns are not read. Any string is a page: unclosed and
    stray tags are repaired as browsers do, and what is no markup is text. A null or empty page has an empty text, no
    characters and no lines. Repeated rows give repeated rows, equal pages equal texts; a page_id may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py()) for t in batch.column(1)]
            sizes, lines = [len(t) for t in texts], [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_chars", "n_lines"])

    return map_batches(pages.select("page_id", "html"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
