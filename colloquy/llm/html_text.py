"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (a new paragraph closes the open one, a cell opens its row, and so on)
make a tree of what a browser shows; visibility rules leave out head matter, scripts, styles, templates, `hidden`,
`display:none`, ... The renderer emits all visible text: blocks on lines of their own with blank lines between
paragraphs, list items with bullets or numbers and indentation, table cells padded to the widths of their columns, and
preformatted text as it is. Formulas are written on one line with `/` for a fraction's bar; of a drawing the text
elements count, of a drop-down the option that it shows, of a list box all options; an object is taken as one that can't
be loaded, so that its fallback is shown; closed details count as open; scripts are taken as on (no `noscript`).

`screen=True` (the query's mode) emits all that a screen shows without the page's style sheets: also elements with
`aria-hidden=true`, the content of `textarea`, and what input fields and buttons say. The plain mode leaves these out.

One map pass, whole pages, no shuffle. Time is linear in a page's length, memory is bounded by the largest page. Depth is
not bounded; only the layout is: indentation grows up to about MOST_LEAD characters, tables within MOST_TABLES tables and those that would
need far more padding than they have text are written row by row without aligned columns, and fractions as deep have no
brackets. Text is never left out.

Defined results: a null or empty page gives an empty text; broken markup is read as browsers read it (a tag that the
page's end cuts off is dropped, an open element ends with the page), nothing raises; repeated rows are rendered alike;
other columns are kept.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import add_columns

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown, and those whose content only the screen mode shows.
UNSEEN = frozenset("head script style template noscript noembed noframes title meta link iframe audio video canvas datalist rp annotation annotation-xml".split())
SCREEN_ONLY = frozenset("textarea input".split())
#: Elements with a layout of their own, and what of a drawing is only referred to or told.
DRAWN = frozenset("math svg select".split())
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: Elements whose content is text up to their own end tag; those of RCDATA have character references.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("textarea title".split())
PRE = frozenset("pre xmp listing".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks, and those that stand apart by a blank line.
BLOCK = frozenset("address article aside body blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu mtr nav ol optgroup option p pre search section summary table caption tbody textarea thead tfoot tr td th ul xmp".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp table ul ol dl figure article section hr form fieldset details".split())
#: A start tag closes open elements of these, up to the named borders.
_CELLS = ("td", "th", "caption")
_ROWS = ("thead", "tbody", "tfoot", "tr", *_CELLS)
_SPECIAL = tuple("article aside blockquote button caption center details dir dl fieldset figcaption figure footer form header main menu nav object ol pre section select table td th ul".split())
CLOSES = {
    "li": (("li",), (*_SPECIAL, "dd", "dt")),
    "dt": (("dt", "dd"), (*_SPECIAL, "li")),
    "dd": (("dt", "dd"), (*_SPECIAL, "li")),
    "tr": (("tr", *_CELLS), ("table",)),
    "td": (_CELLS, ("tr", "table")),
    "th": (_CELLS, ("tr", "table")),
    "tbody": (_ROWS, ("table",)),
    "thead": (_ROWS, ("table",)),
    "tfoot": (_ROWS, ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "caption": (_ROWS, ("table",)),
    "body": (("head",), ("html",)),
    "select": (("select",), ("html",)),
    "input": (("select",), ("html",)),
    "textarea": (("select",), ("html",)),
}
#: Start tags that close an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section table ul li dd dt xmp".split())
#: An end tag never reaches beyond these, but for those of a table's own parts.
SCOPE = ("table", "td", "th", "caption", "template", "html", "body")
TABLE_PARTS = frozenset("table tr tbody thead tfoot body html".split())
#: Where a table waits for rows or cells.
TABLE_CONTEXT = frozenset("table tbody thead tfoot tr".split())
#: Elements that only change how text looks; their end tag leaves blocks open that were opened within.
LOOKS = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: Fields whose value is shown; others show nothing or aren't text.
BUTTONS = frozenset("submit reset button".split())
FIELDS = frozenset(["", *"text search tel url email number date time month week datetime-local".split()])
MOST_LEAD, MOST_TABLES = 120, 12
#: The largest colspan that HTML knows.
MOST_SPAN = 1000

_WS = " \t\n\f\r"
_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*")
_ATTRIBUTE = re.compile(r"[ \t\n\f\r/]*(?:([^ \t\n\f\r/>][^ \t\n\f\r/>=]*)(?:[ \t\n\f\r]*(=)[ \t\n\f\r]*([\"'])?)?)?")
_UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\r\n\f]+")
_MANY_DIGITS = re.compile(r"&#([0-9]{8,})")
_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]+)")


def text_of(raw: str) -> str:
    """raw with its character references replaced; numbers of any length are read."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = _MANY_DIGITS.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), raw)
    return unescape(raw)


def number(text: str | None, least: int, most: int, default: int) -> int:
    """An attribute's integer, within bounds; the default where there is none."""
    m = _INTEGER.match(text or "")
    if not m:
        return default
    sign, digits = m[1][0] == "-", m[1].lstrip("+-").lstrip("0")
    value = int(digits or "0") if len(digits) < 10 else 10**9
    return max(least, min(most, -value if sign else value))


class Node:
    """An element. gone: neither it nor what is in it is shown; shown: its own text is (visibility is inherited)."""

    __slots__ = ("attrs", "children", "gone", "shown", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], gone: bool = False, shown: bool = True) -> None:
        self.tag, self.attrs, self.gone, self.shown, self.children = tag, attrs, gone, shown, []


def attributes(html: str, at: int, kept: bool) -> tuple[dict[str, str], int, bool] | None:
    """The attributes of a tag from `at` on, the place behind its `>`, whether a slash closes it; None if the page ends."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        at = m.end()
        name = m[1]
        if name is None:
            break
        value = ""
        if m[2]:
            if quote := m[3]:
                end = html.find(quote, at)
                if end < 0:
                    return None
                value, at = html[at:end], end + 1
            else:
                v = _UNQUOTED.match(html, at)
                value, at = v[0], v.end()
        if kept:
            found.setdefault(name.lower(), text_of(value))
    return None if at >= len(html) else (found, at + 1, m[0].endswith("/"))


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, name or text, attributes, slash) of texts, start and end tags and raw contents, in order and in linear time."""
    at = start = 0  # where to look on, and where the text began that hasn't been told yet
    endless: set[str] = set()  # raw elements without an end tag from here on
    while (lt := html.find("<", at)) >= 0:
        following = html[lt + 1 : lt + 2]
        m = _NAME.match(html, lt + 1 + (following == "/"))
        if not m and following not in ("!", "?", "/"):
            at = lt + 1
            continue
        if start < lt:
            yield "text", html[start:lt], {}, False
        if not m:
            if html.startswith("<!--", lt):
                end = lt + 4 if html.startswith(">", lt + 4) else html.find("-->", lt + 4)
                at = len(html) if end < 0 else end + (1 if end == lt + 4 and html[end] == ">" else 3)
            else:
                at = html.find(">", lt) + 1 or len(html)
            start = at
            continue
        found = attributes(html, m.end(), following != "/")
        if not found:
            return
        attrs, at, slash = found
        start = at
        tag = m[0].lower()
        if following == "/":
            yield "end", tag, {}, False
            continue
        yield "start", tag, attrs, slash
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[{_WS}/>])", re.IGNORECASE).search(html, at)
            if not end:
                endless.add(tag)
                if not slash:
                    yield "raw", html[at:], {}, False
                    return
                stop = at
            else:
                stop = end.start()
            yield "raw", html[at:stop], {}, False
            start = at = stop
    if start < len(html):
        yield "text", html[start:], {}, False


class Tree:
    """Builds the tree of what is shown; where each tag is open is known, so that no step searches the open elements."""

    def __init__(self, screen: bool) -> None:
        self.screen, self.title = screen, None
        self.root = Node("html", {})
        self.stack, self.places = [self.root], defaultdict(list)
        self.places["html"].append(0)
        self.foreign = 0  # open svg and math elements
        self.blocks: list[int] = []  # where blocks are open

    def deepest(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
            self.foreign -= node.tag in ("svg", "math")

    def close_any(self, tags: tuple[str, ...], borders: tuple[str, ...]) -> None:
        borders = (*borders, "template")
        while (at := self.deepest(tags)) > max(0, self.deepest(borders)):
            self.close(at)

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top.tag == "head" and text.strip(_WS):
            self.close(len(self.stack) - 1)
            top = self.stack[-1]
        if not top.gone and top.shown:
            top.children.append(text)

    def node(self, tag: str, attrs: dict[str, str]) -> Node:
        """A new element under the innermost open one; what isn't shown is no child of it."""
        parent = self.stack[-1]
        gone, shown = parent.gone, parent.shown
        if not gone and (attrs or tag in UNSEEN or tag in SCREEN_ONLY or tag == "dialog"):
            style = attrs.get("style")
            gone = (
                tag in UNSEEN
                or (tag in SCREEN_ONLY and not self.screen)
                or "hidden" in attrs
                or (tag == "dialog" and "open" not in attrs)
                or (not self.screen and attrs.get("aria-hidden", "").lower() == "true")
                or bool(style and _GONE.search(style))
            )
            if style and (told := _VISIBILITY.findall(style)):
                shown = told[-1].lower() == "visible"
        made = Node(tag, attrs, gone, shown)
        if not gone:
            parent.children.append(made)
        return made

    def open(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        self.foreign += node.tag in ("svg", "math")

    def start(self, tag: str, attrs: dict[str, str], slash: bool) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self.close(len(self.stack) - 1)
        if tag in ENDS_P and self.places["p"]:
            self.close_any(("p",), (*SCOPE, "button", "object"))
        if tag in CLOSES:
            self.close_any(*CLOSES[tag])
        if tag in _ROWS and (around := self.deepest(tuple(TABLE_CONTEXT))) > 0:
            self.close(around + 1)  # what else is open between table and row or cell
        top = self.stack[-1].tag
        if tag in HEADINGS and top in HEADINGS:
            self.close(len(self.stack) - 1)
        elif top in TABLE_CONTEXT:
            if tag == "table":
                self.close(self.deepest(("table",)))
            elif tag in ("td", "th") and top != "tr":
                self.open(self.node("tr", {}))
        node = self.node(tag, attrs)
        if tag in VOID or (slash and self.foreign) or (tag == "form" and top in TABLE_CONTEXT):
            return
        self.open(node)

    def raw(self, text: str) -> None:
        """The content of a raw element, which ends with it."""
        node = self.stack[-1]
        if node.tag in RCDATA:
            text = text_of(text)
        if node.tag == "title" and self.title is None and not self.foreign:
            self.title = _SPACE.sub(" ", text).strip()
        if not node.gone and node.shown:
            node.children.append(text)
        self.close(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br", {}))
            return
        at = self.deepest(tuple(HEADINGS) if tag in HEADINGS else (tag,))
        if at <= 0 or (tag not in TABLE_PARTS and self.deepest(SCOPE) > at):
            if tag == "p":
                self.node("p", {})
            return
        if tag in LOOKS and self.blocks and self.blocks[-1] > at and self.stack[at].shown and not self.stack[at].gone:
            return  # blocks that were opened within stay open; how text looks doesn't matter here
        self.close(at)


def tree(html: str, screen: bool = False) -> Tree:
    """The page as a tree; implied tags are inserted, unknown ends are ignored."""
    built = Tree(screen)
    for kind, value, attrs, slash in tokens(html):
        if kind == "text":
            built.text(text_of(value))
        elif kind == "start":
            built.start(value, attrs, slash)
        elif kind == "end":
            built.end(value)
        else:
            built.raw(value)
    return built


class Lines:
    """Collects lines; knows how many blank ones must stand before the next. depth: of tables and fractions around."""

    def __init__(self, depth: int = 0) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.lead = ""
        self.first: str | None = None
        self.depth = depth

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text == " " or text[:1] == " ":
            if self.line and not self.line[-1].endswith((" ", "\n")):
                self.line.append(" ")
            text = text[1:]
        if text:
            self.line.append(text)

    def end(self, apart: bool = False) -> None:
        line = "".join(self.line).strip(" ")
        self.line = []
        if line:
            self.put([line])
        if apart:
            self.blank = True

    def put(self, lines: list[str]) -> None:
        if self.blank and self.out:
            self.out.append("")
        self.blank = False
        for x in lines:
            self.out.append(((self.first if self.first is not None else self.lead) + x).rstrip() if x else "")
            self.first = None


def inner_lines(children: list[Node | str], around: Lines) -> list[str]:
    """What children give as lines of their own."""
    inner = Lines(around.depth + 1)
    render(children, inner)
    inner.end()
    return inner.out


def rows_of(table: Node) -> list[tuple[int, list[Node]]]:
    """The rows as (row group, cells), of the table itself and not of tables within; the head's first, the foot's last."""
    parts: dict[str, list[tuple[int, list[Node]]]] = {"thead": [], "tbody": [], "tfoot": []}
    group = 0

    def cells(row: Node) -> list[Node]:
        return [x for x in row.children if not isinstance(x, str) and x.tag in ("td", "th")]

    for c in table.children:
        if isinstance(c, str):
            continue
        if c.tag == "tr":
            parts["tbody"].append((group, cells(c)))
        elif c.tag in parts:
            into = "tbody" if parts[c.tag] else c.tag
            group += 2  # rows that stand in the table itself afterwards are a group of their own
            parts[into] += [(group - 1, cells(r)) for r in c.children if not isinstance(r, str) and r.tag == "tr"]
    return [*parts["thead"], *parts["tbody"], *parts["tfoot"]]


def placed(rows: list[tuple[int, list[Node]]]) -> list[list[tuple[int, Node]]]:
    """Each row's cells with their columns: those that a cell from above reaches into are left out, spans take several."""
    out: list[list[tuple[int, Node]]] = []
    none = np.empty(0, np.int64)
    starts = ends = untils = none  # cells that reach into rows below: their columns, and the row where they end
    group = None
    for i, (own_group, cells) in enumerate(rows):
        if own_group != group:
            group, starts, ends, untils = own_group, none, none, none
        taken_from: list[int] = []
        taken_to: list[int] = []
        if len(starts):
            live = untils > i
            starts, ends, untils = starts[live], ends[live], untils[live]
        if len(starts):
            reach = np.maximum.accumulate(ends)
            cut = np.flatnonzero(starts[1:] > reach[:-1]) + 1
            taken_from = starts[np.append(0, cut)].tolist()
            taken_to = reach[np.append(cut, len(reach)) - 1].tolist()
        column = k = 0
        line = []
        for cell in cells:
            while k < len(taken_from) and taken_from[k] <= column:
                column = max(column, taken_to[k])
                k += 1
            line.append((column, cell))
            wide = tall = 1
            if cell.attrs:
                wide = number(cell.attrs.get("colspan"), 1, MOST_SPAN, 1)
                tall = number(cell.attrs.get("rowspan"), 0, 65534, 1)
            if tall != 1:
                at = int(np.searchsorted(starts, column))
                starts, ends = np.insert(starts, at, column), np.insert(ends, at, column + wide)
                untils = np.insert(untils, at, i + tall if tall else 1 << 40)
            column += wide
        out.append(line)
    return out


def aligned(table: Node, around: Lines) -> list[str]:
    """The rows as lines, each column as wide as its widest cell; a cell of several lines takes several lines.

    Where this would need much more padding than there is text, cells stand two blanks apart instead.
    """
    rows = []
    for row in placed(rows_of(table)):
        line = [(column, text) for column, cell in row if any(text := inner_lines(cell.children, around))]
        if line:
            rows.append(line)
    width: dict[int, int] = {}
    size = padded = 0
    for row in rows:
        for column, text in row:
            width[column] = max(width.get(column, 0), *map(len, text))
    place, at = {}, 0
    for column in sorted(width):
        place[column] = at
        at += width[column] + 2
    for row in rows:
        for column, text in row:
            size += sum(map(len, text))
        padded += max(len(text) for _, text in row) * place[row[-1][0]]
    free = padded > 65_536 + 16 * size
    out = []
    for row in rows:
        for i in range(max(len(text) for _, text in row)):
            line, at = [], 0
            for column, text in row:
                if i < len(text) and text[i]:
                    line.append(" " * ((2 if line else 0) if free else place[column] - at))
                    line.append(text[i])
                    at = place[column] + len(text[i])
            out.append("".join(line).rstrip())
    return out


def outside_rows(table: Node) -> list[Node | str]:
    """What stands in a table but in none of its rows: captions and stray text."""
    out: list[Node | str] = []
    for c in table.children:
        if isinstance(c, str) or c.tag not in TABLE_CONTEXT:
            out.append(c)
        elif c.tag == "tr":
            out += [x for x in c.children if isinstance(x, str) or x.tag not in ("td", "th")]
        elif c.tag != "table":
            out += outside_rows(c)
    return out


def unaligned(table: Node, lines: Lines) -> None:
    """The rows of a table, each from a line of its own, cells a blank apart."""
    for _, cells in rows_of(table):
        lines.end()
        for cell in cells:
            render(cell.children, lines)
            lines.text(" ")
    lines.end()


def render(children: list[Node | str], lines: Lines) -> None:
    for node in children:
        if isinstance(node, str):
            lines.text(node)
            continue
        tag = node.tag
        if tag == "br":
            if lines.line:
                lines.end()
            else:
                lines.blank = lines.blank or bool(lines.out)
            continue
        if tag == "img":
            if node.shown and (alt := node.attrs.get("alt")):
                lines.text(alt)
            continue
        if tag == "input":
            field(node, lines)
            continue
        block, apart = tag in BLOCK, tag in APART
        if block:
            lines.end(apart)
        if tag in ("svg", "mtd"):
            lines.text(" ")
        if tag == "table":
            render(outside_rows(node), lines)
            lines.end()
            if lines.depth >= MOST_TABLES:
                unaligned(node, lines)
            elif rows := aligned(node, lines):
                lines.put(rows)
        elif tag in PRE or tag == "textarea":
            text: list[str] = []
            plain(node, text, lines)
            inner = "".join(text).replace("\r\n", "\n").strip("\n")
            if inner.strip():
                lines.put(inner.split("\n"))
        elif tag in ("ul", "ol", "menu", "dir"):
            items(node, lines)
        elif tag in ("blockquote", "dd"):
            indented(node.children, lines, "> " if tag == "blockquote" else "    ")
        elif tag == "svg":
            drawing(node.children, lines)
        elif tag == "select":
            choice(node, lines)
        elif tag == "mfrac":
            fraction(node, lines)
        elif tag != "hr":
            render(node.children, lines)
        if block:
            lines.end(apart)


def field(node: Node, lines: Lines) -> None:
    """What an input field or a button says."""
    kind = node.attrs.get("type", "").strip(_WS).lower()
    told = node.attrs.get("value") if kind in BUTTONS else node.attrs.get("value") or node.attrs.get("placeholder") if kind in FIELDS else None
    if told and node.shown:
        lines.text(" ")
        lines.text(told)
        lines.text(" ")


def drawing(children: list[Node | str], lines: Lines) -> None:
    """The text elements of an svg, and the markup within."""
    for node in children:
        if isinstance(node, str) or node.tag in UNDRAWN:
            continue
        if node.tag in ("text", "foreignobject"):
            lines.text(" ")
            render(node.children, lines)
            lines.text(" ")
        else:
            drawing(node.children, lines)


def fraction(node: Node, lines: Lines) -> None:
    """The parts of an mfrac with the bar between them; parts of several signs stand in brackets."""
    parts = [c for c in node.children if not isinstance(c, str)]
    for k, part in enumerate(parts):
        if lines.depth >= MOST_TABLES:
            lines.text("/" if k else "")
            render([part], lines)
            continue
        text = " ".join(inner_lines([part], lines))
        lines.text(("/" if k else "") + (text if len(text) < 2 or text.isdecimal() else f"({text})"))


def options_of(within: Node, listed: bool, disabled: bool, found: list[tuple[Node, bool]]) -> None:
    """The options in a select, and where all are shown the groups' labels, each with whether it is disabled."""
    for c in within.children:
        if isinstance(c, str):
            continue
        off = disabled or "disabled" in c.attrs
        if c.tag == "option":
            found.append((c, off))
            continue
        if listed and c.tag == "optgroup" and c.attrs.get("label"):
            found.append((Node("optgroup", c.attrs), off))
        options_of(c, listed, disabled or (c.tag == "optgroup" and off), found)


def choice(node: Node, lines: Lines) -> None:
    """The option that a drop-down shows; all groups and options of a list box."""
    if not node.shown:
        return
    listed = "multiple" in node.attrs or number(node.attrs.get("size"), 0, MOST_SPAN, 0) > 1
    found: list[tuple[Node, bool]] = []
    options_of(node, listed, False, found)
    if not listed:
        options = [c for c, _ in found if "selected" in c.attrs][-1:] or [c for c, off in found if not off][:1]
    else:
        options = [c for c, _ in found]
    for c in options:
        if listed:
            lines.end()
        else:
            lines.text(" ")
        label = c.attrs.get("label")
        render([label] if label else c.children, lines)
        if listed:
            lines.end()
        else:
            lines.text(" ")


def plain(node: Node, out: list[str], lines: Lines) -> None:
    """The text in a preformatted element as it is; blocks within start and end lines."""
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in DRAWN:
            out.append("\n".join(inner_lines([c], lines)))
        else:
            breaks = c.tag in BLOCK
            if breaks and out and not out[-1].endswith("\n"):
                out.append("\n")
            plain(c, out, lines)
            if breaks and out and not out[-1].endswith("\n"):
                out.append("\n")


def indented(children: list[Node | str], lines: Lines, by: str, first: str | None = None) -> None:
    before, waiting = lines.lead, lines.first
    if len(before) < MOST_LEAD:
        lines.lead = before + by
    if first is not None and len(waiting or before) < MOST_LEAD:
        lines.first = (waiting if waiting is not None else before) + first
    render(children, lines)
    lines.end()
    if first is not None and lines.first is not None:
        lines.first = waiting  # the item was empty
    lines.lead = before


def items(node: Node, lines: Lines) -> None:
    count = number(node.attrs.get("start"), -(10**9), 10**9, 1)
    for c in node.children:
        if not isinstance(c, str) and c.tag == "li":
            count = number(c.attrs.get("value"), -(10**9), 10**9, count) if c.attrs else count
            mark = f"{count}. " if node.tag == "ol" else "- "
            count += 1
            indented(c.children, lines, " " * len(mark), mark)
            lines.blank = False
        else:
            render([c], lines)


def read(html: str | None, screen: bool = False) -> tuple[str | None, str]:
    """A page's title and all its visible text, laid out."""
    if not html:
        return None, ""
    built = tree(html, screen)
    usual = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(usual + 4 * html.count("<"))  # at most so deep; Python's own calls need no stack of the machine
        lines = Lines()
        render(built.root.children, lines)
        lines.end()
    finally:
        sys.setrecursionlimit(usual)
    return built.title, "\n".join(lines.out)


def extract(html: str | None, screen: bool = False) -> str:
    """All visible text of a page, laid out."""
    return read(html, screen)[1]


def title(html: str | None) -> str | None:
    """The text of the page's first title; None if it has none."""
    return tree(html).title if html else None


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", screen: bool = False) -> DataFrame:
    """pages with title and visible text."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [read(x, screen) for x in part.column("html").to_pylist()]
        return {"title": pa.array([t for t, _ in found], pa.string()), text: pa.array([x for _, x in found], pa.string())}

    return add_columns(pages, {"html": F.col(f"`{html}`").cast("string")}, {"title": "string", text: "string"}, make, "html")
