"""HTML extraction by layout-aware rendering.

A tree builder closes elements whose end tags may be left out (p, li, td, tr, option, dt, dd and the like) and ignores end
tags that fit nothing. It knows where each open element stands, so that its time does not grow with the depth. The renderer
walks the tree without recursion and emits all visible text: head, scripts, styles, templates, fallback contents, closed
dialogs and whatever is hidden by attribute or inline style emit none (a part made visible within an invisible one does);
of a select the chosen options count. Paragraph-like blocks are set off by blank lines, other blocks by line ends; list items
get bullets or numbers and indents; tables become lines whose cells, spanning ones included, are padded to the width of
their columns, wide characters as two places; pre keeps its white space.

Defined results: null and empty html give an empty text; a tag or comment that is cut off by the end is dropped, other
markup that is cut off is read as far as it goes; very long pages are one text, read by one task; rows that repeat a page_id are
each rendered; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.llm.common import map_batches, record, sliced

#: Comments; other markup declarations; tags. A quote opens a string only where a value begins; a tag that ends with the text is none.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?|=)*+)(>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*))?)?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE_SPACE = re.compile(r"\s+|/\*.*?\*/", re.DOTALL)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template title meta link base noscript noembed noframes iframe object audio video canvas datalist param source track area desc metadata defs symbol annotation annotation-xml".split())
#: Blocks with blank lines around them, and other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details div dt figcaption footer form header hgroup legend li main menu nav optgroup option section summary caption tbody thead tfoot tr td th".split())
#: What an open element does not outlive: start tag -> elements that it ends, and elements that shield them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "td", "th")), "dt": (("dt", "dd"), ("dl", "td", "th")), "dd": (("dt", "dd"), ("dl", "td", "th")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select",)),
    "body": (("head",), ()),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
_PRE = ("pre", "textarea")
_P_SHIELD = ("td", "th", "table", "button", "caption", "object")
_HEAD = frozenset("title meta link base script style template noscript".split())


#: Most columns and rows that a cell may span.
SPAN_COLUMNS, SPAN_ROWS = 1000, 65534


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs = tag, attrs
        self.kids: list[Node | str] = []


def build_tree(source: str) -> Node:
    """The elements and texts of a page; texts have their entities resolved."""
    top = Node("html")
    stack = [top]
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().tag].pop()

    def innermost(names: tuple[str, ...]) -> int:
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def close(names: tuple[str, ...], shield: tuple[str, ...] = ()) -> None:
        if (at := innermost(names)) and at >= innermost(shield):
            cut(at)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                cut(len(stack) - 1)
            stack[-1].kids.append(entities.unescape(s))

    at = 0
    while m := _TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places.get("p"):
                stack[-1].kids.append(Node("p"))
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag not in ("html", "body"):
                close((tag,), () if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else ("td", "th", "table"))
            continue
        if tag == "html":
            top.attrs += m[3]
            continue
        if stack[-1].tag == "head" and tag not in _HEAD and tag != "head":
            cut(len(stack) - 1)
        if tag in ENDS_P:
            close(("p",), _P_SHIELD)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag != "tr" and places.get("table"):
            row = Node("tr")
            stack[-1].kids.append(row)
            push(row)
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in ESCAPABLE and not places.get("svg"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            inner, at = (source[at : end.start()], end.end()) if end else (source[at:], len(source))
            if tag in ESCAPABLE:
                node.kids.append(entities.unescape(inner))
            continue
        push(node)
    text(source[at:])
    return top


def attributes(node: Node) -> dict[str, str]:
    """Names and values, in lower case; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(node.attrs):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower())
    return out


def _seen(node: Node, visible: bool) -> bool | None:
    """Whether an element's text is visible, given whether its parent's is; None if it is not laid out at all."""
    if node.tag in UNSEEN:
        return None
    if not node.attrs:
        return None if node.tag == "dialog" else visible
    low = node.attrs.lower()
    if node.tag != "dialog" and "hidden" not in low and "none" not in low and "visib" not in low and "collapse" not in low:
        return visible
    told = attributes(node)
    style = _STYLE_SPACE.sub("", told.get("style", "")).split(";")
    if told.get("hidden", "until-found") != "until-found" or node.tag == "dialog" and "open" not in told or any(x.startswith("display:none") for x in style):
        return None
    for x in style:
        if x.startswith("visibility:"):
            visible = not x.startswith(("visibility:hidden", "visibility:collapse"))
    return visible


def _chosen(select: Node) -> list[Node]:
    """The options that a select shows: all of a list, else the selected one, else the first."""
    options, work = [], list(reversed(select.kids))
    while work:
        k = work.pop()
        if isinstance(k, Node):
            if k.tag == "option":
                options.append(k)
            else:
                work.extend(reversed(k.kids))
    told = attributes(select) if select.attrs else {}
    if "multiple" in told or told.get("size", "1") not in ("", "0", "1"):
        return options
    picked = [o for o in options if o.attrs and "selected" in attributes(o)]
    return picked[-1:] or options[:1]


class Box:
    """Text set so far: finished lines, and the line being set."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = self.begun = False  # a blank line is due; the line being set has visible text

    def inline(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if not self.begun:
            s = s.lstrip(" ")
        elif self.line[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)
            self.begun = True

    def wrap(self, blank: bool = False) -> None:
        """End the line, if one is begun."""
        if self.begun:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append("".join(self.line).rstrip(" "))
            self.line, self.begun = [], False
        self.blank = self.blank or blank

    def put(self, lines: list[str]) -> None:
        """Set finished lines."""
        self.wrap()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines


Cell = tuple[list[str], int, int]  # lines, columns, rows


def _width(line: str) -> int:
    """Places that a line takes: two for a wide character (East Asian ones), none for a combining mark."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _grid(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table's rows of cells, each column as wide as its widest line; what spans columns may be as wide as all of them."""
    placed: list[list[tuple[int, Cell]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still takes
    widths: dict[int, int] = {}
    for r in rows:
        at, line = 0, []
        for cell in r:
            while taken.get(at):
                at += 1
            line.append((at, cell))
            widths.setdefault(at, 0)
            at += cell[1]
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        for k, cell in line:
            if cell[2] > 1:
                taken |= dict.fromkeys(range(k, k + cell[1]), cell[2] - 1)
            if cell[1] == 1:
                widths[k] = max(widths[k], max(map(_width, cell[0]), default=0))
        placed.append(line)
    columns = sorted(widths)  # those in which a cell begins
    for line in placed:
        for k, (lines, span, _) in line:
            inside = columns[bisect_left(columns, k) : bisect_left(columns, k + span)]
            if span > 1:
                widths[inside[-1]] += max(0, max(map(_width, lines), default=0) - sum(widths[c] + 2 for c in inside) + 2)
    start = dict(zip(columns, accumulate((widths[c] + 2 for c in columns), initial=0), strict=False))
    out = []
    for line in placed:
        for i in range(max((len(c[0]) for _, c in line), default=0)):
            parts, wide = [], 0
            for k, (lines, _, _) in line:
                if i < len(lines):
                    gap = max(0, start[k] - wide)
                    parts += (" " * gap, lines[i])
                    wide += gap + _width(lines[i])
            out.append("".join(parts).rstrip(" "))
    return out


def _span(told: dict[str, str], name: str, most: int) -> int:
    n = re.match(r"\s*(\d{1,9})", told.get(name, ""))
    return max(1, min(most, int(n[1]))) if n else 1


def render(source: str | None) -> str:
    """The visible text of a page."""
    if not source:
        return ""
    boxes = [Box()]
    lists: list[list] = []  # of each open list: kind, number
    tables: list[list[list[Cell]]] = []  # of each open table: its rows of cells
    pre = 0
    work: list[tuple[str, Node | str, bool]] = [("in", build_tree(source), True)]
    while work:
        step, node, visible = work.pop()
        box = boxes[-1]
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                for k, line in enumerate(node.replace("\r\n", "\n").split("\n")):
                    if k:
                        box.begun = box.begun or bool(box.lines)
                        box.wrap()
                    if line:
                        box.line.append(line)
                        box.begun = True
            else:
                box.inline(node)
            continue
        tag = node.tag
        if step == "in":
            seen = _seen(node, visible)
            if seen is None:
                continue
            if tag == "br":
                box.begun = True
                box.wrap()
                continue
            cell = tag in ("td", "th", "caption") and bool(tables)
            item = tag == "li"
            if cell or item:
                if item:
                    box.wrap()
                elif not tables[-1]:
                    tables[-1].append([])
                boxes.append(Box())
            elif tag == "table":
                box.wrap(blank=True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCK:
                nested = tag in ("ul", "ol") and lists
                box.wrap(blank=tag in SPACED and not nested)
            if tag in ("ul", "ol", "menu"):
                start = re.search(r"start\s*=\s*[\"']?(-?\d{1,9})", node.attrs) if tag == "ol" else None
                lists.append([tag, int(start[1]) if start else 1])
            pre += tag in _PRE
            work.append(("out", node, seen))
            work.extend(("in", k, seen) for k in reversed(node.kids if tag != "select" else _chosen(node)))
            continue
        pre -= tag in _PRE
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        if tag in ("td", "th", "caption") and tables:
            box.wrap()
            lines = box.lines
            boxes.pop()
            if tag == "caption":
                boxes[-1].put(lines)
            else:
                told = attributes(node) if "span" in node.attrs.lower() else {}
                tables[-1][-1].append((lines, _span(told, "colspan", SPAN_COLUMNS), _span(told, "rowspan", SPAN_ROWS)))
        elif tag == "li":
            box.wrap()
            lines = box.lines
            boxes.pop()
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            boxes[-1].put([(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(lines)])
        elif tag == "table":
            boxes[-1].put(_grid([r for r in tables.pop() if r]))
            boxes[-1].wrap(blank=True)
        elif tag in BLOCK and tag != "tr":
            box.wrap(blank=tag in SPACED and not (tag in ("ul", "ol") and lists))
    boxes[0].wrap()
    return "\n".join(boxes[0].lines)


_OUT = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64())])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, text, n_lines."""

    def make() -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, raw in sliced(batches, "html"):
                out = [render(h.decode("utf-8", "replace")) for h in raw]
                yield record(_OUT, page_id=part.column("page_id"), text=out, n_lines=[t.count("\n") + 1 if t else 0 for t in out])

        return run

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), make, "page_id long, text string, n_lines long")
