"""Layout-aware rendering of HTML to text.

A page is cut into tags and text in one pass forward, and built into a tree
with the implied tags of HTML: what can't stand in a head ends it, a block ends
an open paragraph, an item ends the item before it, and so on; void elements
hold nothing. The tree is rendered as a reader sees it:
what is never shown (head, scripts, styles, templates, hidden elements) is left
out and all other text is kept in order. Paragraphs and headings stand apart by
a blank line, other blocks by a line break, list items get their mark and
indent, preformatted text keeps its blanks, and the cells of a table's rows are
aligned in columns, those that span several columns or rows included.

Edge cases: a null or empty page gives the empty text, a page without tags its
own text. Unclosed, misnested and unknown tags are accepted; a tag or quote
that never ends swallows the rest of the page, as in browsers. Elements nested
deeper than 256 levels are put beside each other, as browsers do, so depth is
bounded. Cells wrap at 40 characters between words, and columns are as wide as
their widest line; the cells of a table of more than 1000 characters across
follow each other on lines of their own, so the text stays in proportion to the
page. Time is in proportion to the page, too. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from html import unescape
from textwrap import wrap
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe datalist rp audio video canvas desc defs metadata symbol annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = APART | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main nav section summary tr thead tbody tfoot td th".split()
)
FOREIGN = frozenset(("svg", "math"))
CELLS, ROWS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends the nearest open element of these, unless a wall is nearer.
ENDS = (
    {t: frozenset(("p",)) for t in BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}}
    | {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",))}
    | dict.fromkeys(CELLS, CELLS)
    | {"tr": CELLS | {"tr"}}
    | dict.fromkeys(ROWS, CELLS | ROWS | {"tr"})
)
WALLS = {"li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
DEEPEST = 256
WIDEST = 40

WIDEST_TABLE = 1000
#: What a head can hold.
OF_HEAD = frozenset("base link meta noscript script style template title".split())

# No pattern gives back what it took, so each takes time in proportion to what it reads.
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?+")
OPEN_QUOTE = re.compile(r"\s*+=\s*+[\"']")
BETWEEN = re.compile(r"[\s/]*+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


class Node:
    __slots__ = ("tag", "attributes", "parts", "seen")

    def __init__(self, tag: str, attributes: str = "", seen: bool = True):
        """`seen` is what the element inherits: unlike display, visibility can be
        set back by a child, and what is unseen keeps its place."""
        self.tag, self.attributes, self.parts = tag, attributes, []
        own = VISIBILITY.findall(self.named().get("style", "")) if "visibility" in attributes.lower() else []
        self.seen = own[-1].lower() == "visible" if own else seen

    def shown(self) -> bool:
        if self.tag in HIDDEN:
            return False
        a = self.attributes.lower()
        if self.tag == "dialog" and "open" not in a:
            return False
        if "hidden" not in a and "style" not in a:
            return True
        own = self.named()
        return "hidden" not in own and not NOT_SHOWN.search(own.get("style", ""))

    def named(self) -> dict[str, str]:
        """Attribute values by name; of repeated names the first counts."""
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return found

    def options(self) -> list[Node]:
        inner = [x for x in self.parts if isinstance(x, Node) and x.shown()]
        return [o for x in inner for o in ([x] if x.tag == "option" else x.options())]

    def chosen(self) -> list[Node]:
        """The options that a select shows: all of a list, else the last one
        that is selected or the first."""
        found = self.options()
        if "multiple" in self.named():
            return found
        return [o for o in found if "selected" in o.named()][-1:] or found[:1]


def tokens(html: str) -> Iterator[tuple[str, str, int]]:
    """Text as ("", text, end); start and end tags as (name, attributes, end)
    and ("/name", "", end). Sent a place, goes on from there."""
    at, size = 0, len(html)
    while at < size:
        lower = html.find("<", at)
        if lower < 0:
            lower = size
        following = html[lower + 1 : lower + 2]
        end = following == "/"
        name = NAME.match(html, lower + 1 + end)
        if not name and not end and following not in ("!", "?"):  # a mere sign, or the end of the page
            here = min(lower + 1, size)
            yield "", html[at:here], here
            at = here
            continue
        if lower > at:
            yield "", html[at:lower], lower
        if not name:  # a comment, a declaration, or nonsense that is treated like one
            if html.startswith("<!--", lower):
                close = html.find("-->", lower + 2)
                at = close + 3 if close >= 0 else size
            else:
                close = html.find(">", lower + 1)
                at = close + 1 if close >= 0 else size
            continue
        at = name.end()
        while True:
            attribute = ATTRIBUTE.match(html, at)
            if not attribute:
                break
            at = attribute.end()
            if OPEN_QUOTE.match(html, at):  # a quote that never ends
                at = size
        at = BETWEEN.match(html, at).end()
        if at >= size:
            return
        jump = yield ("/" if end else "") + name[0].lower(), "" if end else html[name.end() : at], at + 1
        at = jump or at + 1


def tree(html: str) -> Node:
    root = Node("html")
    stack = [root]

    def end(names: frozenset[str], wall: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                if not names & CELLS:
                    return
            elif stack[k].tag in wall or stack[k].tag == "table":
                return

    found, jump = tokens(html), None
    begun = False  # whether the body has
    while True:
        try:
            tag, own, at = found.send(jump)
        except StopIteration:
            return root
        jump = None
        if stack[-1].tag == "head" and (tag not in OF_HEAD if tag else own.strip()) and tag not in ("/head", "head", "html"):
            stack.pop()
        if not tag:
            begun = begun or stack[-1] is root and bool(own.strip())
            if stack[-1].seen:
                stack[-1].parts.append(unescape(own))
            continue
        if tag == "/br":
            tag = "br"
        if tag[0] == "/":
            tag = tag[1:]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in CELLS and tag not in ("tr", "table", "thead", "tbody", "tfoot", "body", "html"):
                    break
            continue
        if tag in ("html", "body") or tag == "head" and (begun or len(stack) > 1):
            begun = begun or tag == "body"
            continue
        begun = begun or tag not in OF_HEAD and tag != "head"
        if tag in ENDS:
            end(ENDS[tag], WALLS.get(tag, frozenset()))
        node = Node(tag, own, stack[-1].seen)
        stack[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if node.seen:
                node.parts.append(unescape(html[at : close.start() if close else len(html)]))
            over = html.find(">", close.end()) if close else -1
            jump = over + 1 if over >= 0 else len(html)
        elif tag not in VOID and not (own.endswith("/") and any(x.tag in FOREIGN for x in stack)) and (len(stack) != DEEPEST or not node.shown() or not node.seen):
            if len(stack) == DEEPEST and not node.seen:
                node.attributes = "hidden"
            stack.append(node)  # past the depth only within a hidden one, which is not rendered


class Flow:
    """Lines of a block under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.blank = 0  # blank lines owed before the next line
        self.indent, self.mark = "", ""

    def put(self, line: str) -> None:
        if self.lines and self.blank:
            self.lines.append("")
        self.blank = 0
        self.lines.append(self.indent + self.mark + line if self.mark or line else "")
        if self.mark:
            self.indent, self.mark = self.indent + " " * len(self.mark), ""

    def flush(self) -> None:
        line = " ".join("".join(self.open).split())
        self.open.clear()
        if line:
            self.put(line)

    def apart(self, by: int) -> None:
        self.flush()
        self.blank = max(self.blank, by)


def _table(node: Node, flow: Flow) -> None:
    rows: list[list[Cell]] = []
    for part in node.parts:
        if isinstance(part, str):
            flow.open.append(part)
        elif part.shown():
            if part.tag in ROWS:
                flow.flush()
                _table_rows(part, rows)
            elif part.tag == "tr":
                flow.flush()
                _table_rows(_holding(part), rows)
            else:
                render(part, flow)
    flow.apart(0)
    for line in _aligned(rows):
        flow.put(line)


class Cell(NamedTuple):
    lines: list[str]
    across: int
    down: int


def _aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table, its columns two blanks apart."""
    placed: list[list[tuple[int, Cell]]] = []
    taken: list[tuple[int, int, int]] = []  # columns from, to, and rows left that cells above take
    for row in rows:
        at, own, now = 0, [], sorted(taken)
        for cell in row:
            for first, after, _ in now:
                if first <= at < after:
                    at = after
            own.append((at, cell))
            if cell.down > 1:
                taken.append((at, at + cell.across, cell.down))
            at += cell.across
        placed.append(own)
        taken = [(a, b, n - 1) for a, b, n in taken if n > 1]
        if len(own) + len(taken) > WIDEST_TABLE // 2:
            return [line for row in rows for cell in row for line in cell.lines]
    # columns in which no cell starts have no width
    columns = sorted({at for row in placed for at, _ in row})
    widths = [0] * len(columns)
    spans = []
    for row in placed:
        for at, cell in row:
            first = bisect_left(columns, at)
            spans.append((bisect_left(columns, at + cell.across) - first, first, max(map(len, cell.lines), default=0)))
    for span, first, width in sorted(spans):
        inner = sum(widths[first : first + span]) + 2 * (span - 1)
        widths[first + span - 1] += max(0, width - inner)
    starts = [0]
    for width in widths:
        starts.append(starts[-1] + width + 2)
    if starts[-1] > WIDEST_TABLE:
        return [line for row in rows for cell in row for line in cell.lines]
    out = []
    for row in placed:
        for n in range(max((len(cell.lines) for _, cell in row), default=0)):
            line = ""
            for at, cell in row:
                if n < len(cell.lines):
                    line = line.ljust(starts[bisect_left(columns, at)]) + cell.lines[n]
            out.append(line)
    return out


def _holding(row: Node) -> Node:
    holder = Node("tbody")
    holder.parts.append(row)
    return holder


def _span(cell: Node, name: str, most: int) -> int:
    if "span" not in cell.attributes.lower():
        return 1
    digits = re.match(r"\s*\+?(\d{1,6})", cell.named().get(name, ""))
    return min(max(int(digits[1]), 1), most) if digits else 1


def _table_rows(group: Node, rows: list[list[Cell]]) -> None:
    for row in group.parts:
        if isinstance(row, str):
            if row.strip():
                rows.append([Cell([" ".join(row.split())], 1, 1)])
        elif row.shown():
            cells = []
            for cell in row.parts if row.tag == "tr" else [row]:
                own = Flow()
                across = down = 1
                if isinstance(cell, str):
                    own.open.append(cell)
                    own.flush()
                    if not own.lines:
                        continue
                elif cell.shown():
                    across, down = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
                    render(cell, own)
                    own.flush()
                else:
                    continue
                lines = [x for line in own.lines for x in (wrap(line, WIDEST, break_long_words=False, break_on_hyphens=False) if len(line) > WIDEST else [line])]
                cells.append(Cell(lines, across, down))
            rows.append(cells)


def _numbered(node: Node, name: str, otherwise: int) -> int:
    """The number in an attribute of a list or item."""
    digits = NUMBER.match(node.named().get(name, "")) if name in node.attributes.lower() else None
    return int(digits[1]) if digits else otherwise


def _numbering(node: Node) -> tuple[int, int]:
    """First number and step of an ordered list; a reversed one counts down to 1."""
    back = "reversed" in node.attributes.lower() and "reversed" in node.named()
    items = sum(not isinstance(part, str) and part.tag == "li" and part.shown() for part in node.parts) if back else 1
    return _numbered(node, "start", items), -1 if back else 1


def render(node: Node, flow: Flow, pre: bool = False) -> None:
    tag = node.tag
    if tag == "br":
        flow.flush() if "".join(flow.open).strip() else flow.apart(0)
        return
    if tag == "table":
        flow.apart(1)
        _table(node, flow)
        flow.apart(1)
        return
    if tag == "select":
        for option in node.chosen():
            flow.open.append(" ")
            render(option, flow, pre)
            flow.open.append(" ")
        return
    block = tag in BLOCK
    nested = tag in ("ul", "ol") and bool(flow.indent or flow.mark)
    if block:
        flow.apart(1 if tag in APART and not nested else 0)
    number, step = _numbering(node) if tag == "ol" else (1, 1)
    closed = tag == "details" and not re.search(r"\bopen\b", node.attributes, re.I)
    for part in node.parts:
        if isinstance(part, str):
            if closed and part.strip():
                continue
            if pre or tag == "pre":
                lines = part.replace("\r\n", "\n").split("\n")
                for line in lines[:-1]:
                    flow.put("".join(flow.open) + line)
                    flow.open.clear()
                flow.open.append(lines[-1])
            else:
                flow.open.append(part)
        elif part.shown() and not (closed and part.tag != "summary"):
            if part.tag == "li" or (part.tag == "dd" and tag == "dl"):
                flow.flush()
                before = flow.indent
                if part.tag == "li":
                    number = _numbered(part, "value", number) if tag == "ol" else number
                    flow.indent, flow.mark = before + flow.mark, f"{number}. " if tag == "ol" else "- "
                    number += step
                else:
                    flow.indent = before + "  "
                render(part, flow, pre)
                flow.flush()
                flow.indent, flow.mark = before, ""
            else:
                render(part, flow, pre or tag == "pre")
    if block:
        if pre or tag == "pre":
            if rest := "".join(flow.open).rstrip():
                flow.put(rest)
            flow.open.clear()
        flow.apart(1 if tag in APART and not nested else 0)


def text_of(html: str | None) -> str:
    flow = Flow()
    render(tree(html or ""), flow)
    flow.flush()
    return "\n".join(x.rstrip() for x in flow.lines)


def extract(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",), column: str = "text") -> DataFrame:
    """`keep` with `column`, the visible text of each page. No shuffle."""
    schema = pages.select(*keep).withColumn(column, F.lit("")).schema
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=at):
            texts = [text_of(h) for h in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*keep, pages[html].alias("__html")).mapInArrow(run, schema)
