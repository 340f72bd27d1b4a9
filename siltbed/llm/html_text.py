"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags make a tree (html, head and body aren't needed; p, li, dt, dd, options, rows and
cells are closed by what follows; void elements have no children; what stands in script, style, title, textarea and xmp is no markup).
A renderer walks it once: elements that aren't drawn (head, script, style, template, hidden ones, those styled away, the rest of closed
details, closed dialogs) give nothing, blocks are set apart by line breaks, paragraphs and headings by a blank line, list items have
bullets or numbers and are indented by depth, pre and xmp keep their white space. ``visibility`` is inherited and may be set back by an
element inside. svg and math give the text that they draw, buttons and fields their captions and values; aria-hidden hides nothing from
the screen. All visible text comes out, boilerplate included.

Tables are rows of cells on a grid of columns, with colspan and rowspan. A cell starts at its column's offset, or two spaces behind the
cell before it where that is longer. The grid has ``COLUMNS`` columns; cells longer than ``WIDE`` widen no column, and columns that would
start behind ``LINE`` aren't aligned; their cells follow two spaces apart. Indents and cells nested beyond ``NESTED`` are laid out flat.
So the text is never longer than a constant times the html, and time grows with the html's length whatever its nesting.

Null and empty html gives empty text; broken markup gives what can be read; repeated rows are rendered each; other columns are
ignored. Neither builder nor renderer recurses, so deep nesting is no limit.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltbed.llm import common as C

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INVISIBLE = frozenset("head script style template noscript title datalist iframe object audio video canvas area param rp noembed noframes".split())
#: Elements that are not drawn where they stand inside svg or math.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup "
                  "html legend li main menu nav ol optgroup option search section summary ul table thead tbody tfoot tr caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table ul ol dl hr figure".split())
CLOSES_P = BLOCK | SPACED - frozenset("body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
               "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"},
               "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}

COLUMNS, WIDE, LINE, NESTED = 64, 80, 200, 32

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*+)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: Kinds of input that draw their value.
CAPTIONED = frozenset("submit button reset text search url tel email number date time month week datetime-local".split())
BARRIER = frozenset("table td th".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())


class Node:
    """An element: ``hidden`` ones aren't drawn at all; ``shown`` is the visibility that its style sets, or None."""

    __slots__ = ("name", "hidden", "shown", "start", "span", "children")

    def __init__(self, name: str, hidden: bool = False, start: int = 1):
        self.name, self.hidden, self.start, self.children = name, hidden, start, []
        self.shown: bool | None = None
        self.span = (1, 1)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(m[1].lower(), entities.unescape(value))  # of an attribute given twice the first counts
    return out


def number(text: str | None, most: int, other: int) -> int:
    """A whole number up to ``most``, or ``other``."""
    text = (text or "").strip()
    return min(int(text), most) if text.isascii() and text.isdigit() and len(text) < 9 else other


def caption(name: str, given: dict[str, str]) -> str:
    """What an element without content draws: a picture's replacement, a button's caption, a field's value or hint."""
    if name == "img":
        return given.get("alt", "")
    kind = given.get("type", "text").strip().lower() or "text"
    if kind == "image":
        return given.get("alt", "Submit")
    if kind in ("submit", "reset") and "value" not in given:
        return "Submit" if kind == "submit" else "Reset"
    return (given.get("value") or given.get("placeholder", "")) if kind in CAPTIONED else ""


class Builder:
    """Open elements, with the depths of each name's open elements, so that closing never walks the stack."""

    def __init__(self):
        self.root = Node("#root")
        self.stack, self.depths = [self.root], {}

    def depth_of(self, names) -> int:
        """Depth of the innermost open element among ``names``, or 0."""
        return max((at[-1] for x in names if (at := self.depths.get(x))), default=0)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().name].pop()

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def close_implied(self, names: set[str] | frozenset[str], scope: set[str]) -> None:
        """Ends the innermost of ``names`` that is open within ``scope`` and a table, and those of ``names`` right around it."""
        while (at := self.depth_of(names)) and at > self.depth_of(scope) and at > self.depth_of(("table",)):
            self.pop_to(at)
            if self.stack[-1].name not in names:
                return

    def close(self, name: str) -> None:
        """An end tag; it doesn't reach out of its cell, unless it is a part of the table itself."""
        at = self.depth_of((name,))
        if at and (name in TABLE_PARTS or at >= self.depth_of(BARRIER)):
            self.pop_to(at)
        elif not at and name == "p":
            self.stack[-1].children.append(Node("p"))
        elif name == "br":
            self.stack[-1].children.append(Node("br"))


def build(source: str) -> Node:
    """The tree; end tags that close nothing are ignored, and open elements end with the text."""
    tree, at, n = Builder(), 0, len(source)
    while at < n and (m := TAG.search(source, at)):
        if m.start() > at:
            tree.stack[-1].children.append(entities.unescape(source[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            tree.close(name)
            continue
        if name in CLOSES_P:
            tree.close_implied({"p"}, {"button", "td", "th", "caption"})
        if name in IMPLIED_END:
            tree.close_implied(IMPLIED_END[name], SCOPE.get(name, set()))
        if name in HEADINGS and tree.stack[-1].name in HEADINGS:
            tree.pop_to(len(tree.stack) - 1)
        extra = m[3] or ""
        given = attributes(extra) if extra.strip("/ \t\r\n\f") else {}
        foreign = tree.depths.get("svg") or tree.depths.get("math")
        node = Node("pre" if name in ("xmp", "plaintext") else name)
        style = {k.lower(): v.lower() for k, v in STYLE.findall(given.get("style", ""))}
        node.hidden = (name in INVISIBLE or bool(foreign) and name in UNDRAWN or style.get("display", "none" if "hidden" in given else "") == "none"
                       or name == "dialog" and "open" not in given)
        if "visibility" in style:
            node.shown = style["visibility"] not in ("hidden", "collapse")
        if name == "ol":
            back = given.get("start", "").strip().startswith("-")
            node.start = -number(given["start"].strip()[1:], 10**8, -1) if back else number(given.get("start"), 10**8, 1)
        elif name == "details" and "open" in given:
            node.start = 0  # open: all of it is drawn
        elif name in ("td", "th") and ("colspan" in given or "rowspan" in given):
            rows = number(given.get("rowspan"), 65534, 1)
            node.span = (max(1, number(given.get("colspan"), 1000, 1)), rows or 65534)
        if foreign and name in ("text", "mtd"):
            tree.stack[-1].children.append(" ")  # labels and cells are apart on the screen
        tree.stack[-1].children.append(node)
        if (foreign or name in ("svg", "math")) and extra.rstrip().endswith("/"):
            continue
        if name in VOID:
            if name in ("img", "input") and (drawn := caption(name, given)):
                node.children.append(drawn)
            continue
        if name in RAW:
            end = None if name == "plaintext" else RAW_END[name].search(source, at)
            stop = end.start() if end else n
            if name == "textarea":
                node.children.append(entities.unescape(source[at:stop]))
            elif name in ("xmp", "plaintext"):
                node.children.append(source[at:stop])
            at = end.end() if end else n
            continue
        tree.push(node)
    if at < n:
        tree.stack[-1].children.append(entities.unescape(source[at:]))
    return tree.root


RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I) for name in RAW}


class Sheet:
    """Lines under construction: collapses white space and keeps at most one blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = self.space = False

    def text(self, words: str) -> None:
        if not words:
            return
        flat = SPACES.sub(" ", words)
        if flat[0] == " ":
            self.space = True
            flat = flat[1:]
        if not flat:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = flat[-1] == " "
        self.start()
        self.line.append(flat[:-1] if self.space else flat)

    def start(self) -> None:
        if self.blank and self.lines and not self.line:
            self.lines.append("")
        self.blank = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def raw(self, lines: list[str]) -> None:
        """Finished lines as they are."""
        self.end_line()
        if lines:
            self.start()
            self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


Cell = tuple[list[str], int, int]  # lines, columns, rows


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Each row's cells with their columns: a cell takes the next column that no cell of an earlier row reaches down to. Columns from
    ``COLUMNS`` on are not told apart."""
    left = [0] * COLUMNS  # rows that a column is still taken
    out, any_left = [], False
    for row in rows:
        c, line = 0, []
        for cell in row:
            while any_left and c < COLUMNS and left[c] > 0:
                c += 1
            line.append((min(c, COLUMNS), cell))
            end = min(COLUMNS, c + cell[1])
            if cell[2] > 1:
                left[c:end] = [cell[2]] * max(0, end - c)
                any_left = True
            c = end
        if any_left:
            left = [max(0, x - 1) for x in left]
            any_left = any(left)
        out.append(line)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells as lines, cells starting at the offsets of their columns; empty rows and columns take no room."""
    grid = placed(rows)
    widths = [0] * (COLUMNS + 1)
    for row in grid:
        for c, (lines, across, _) in row:
            if across == 1 and c < COLUMNS:
                widths[c] = max(widths[c], max((len(x) for x in lines if len(x) <= WIDE), default=0))
    offsets, at = [], 0
    for w in widths:
        offsets.append(at)
        at += w + 2 if w else 0
    out = []
    for row in grid:
        held = [(offsets[c] if c < COLUMNS and offsets[c] <= LINE else 0, lines) for c, (lines, _, _) in row if lines]
        for k in range(max((len(lines) for _, lines in held), default=0)):
            parts, size = [], 0
            for offset, lines in held:
                if k < len(lines) and lines[k]:
                    gap = max(offset - size, 2 if size else 0)
                    parts += [" " * gap, lines[k]]
                    size += gap + len(lines[k])
            out.append("".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree. Steps of the explicit stack are (kind, node); ``inside`` has one entry for each open element that has
    a sheet of its own (lists' items, cells, tables, captions), and ``veiled`` the visibility of those that set it."""
    sheets, tables, lists, veiled = [Sheet()], [], [], [False]
    pre = 0
    stack: list[tuple] = [("open", root)]
    while stack:
        step, node = stack.pop()
        sheet = sheets[-1]
        if step == "open":
            if isinstance(node, str):
                if veiled[-1]:
                    continue
                if pre:
                    first, *rest = node.replace("\r\n", "\n").split("\n")
                    sheet.start()
                    sheet.line.append(first)
                    for x in rest:
                        sheet.lines.append("".join(sheet.line).rstrip())
                        sheet.line = [x]
                else:
                    sheet.text(node)
                continue
            if node.hidden:
                continue
            name = node.name
            if name == "br":
                if sheet.line:
                    sheet.end_line()
                else:
                    sheet.blank = bool(sheet.lines)
                continue
            if node.shown is not None:
                veiled.append(not node.shown)
            if name in SPACED:
                (sheet.end_line if name in ("ul", "ol") and lists else sheet.gap)()
            elif name in BLOCK:
                sheet.end_line()
            room = len(sheets) <= NESTED
            close = "close"
            if name in ("ul", "ol", "menu", "dir"):
                lists.append([name, node.start])
            elif name in ("li", "dd"):
                if room:
                    sheets.append(Sheet())
                else:
                    close = "flat"
                    if name == "li" and not veiled[-1]:
                        sheet.text(marker(lists))
                        sheet.space = True
            elif name == "pre":
                pre += 1
            elif name == "table":
                if room:
                    tables.append([])
                    sheets.append(Sheet())
                else:
                    close = "flat"
                    tables.append(None)
            elif name == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif name in ("td", "th"):
                if tables and tables[-1] is not None:
                    if not tables[-1]:
                        tables[-1].append([])
                    sheets.append(Sheet())
                else:
                    close = "flat"
                    sheet.text("  ")
            elif name == "caption" and tables and tables[-1] is not None:
                sheets.append(Sheet())
            elif name == "caption":
                close = "flat"
            elif name == "q" and not veiled[-1]:
                sheet.text('"')
            elif name in ("input", "textarea", "button"):
                sheet.text(" ")
            stack.append((close, node))
            children = node.children
            if name == "details" and node.start:
                children = [next((c for c in children if not isinstance(c, str) and c.name == "summary"), "")]
            stack += [("open", c) for c in reversed(children)]
            continue
        name = node.name
        if name in ("ul", "ol", "menu", "dir"):
            sheet.end_line()
            lists.pop()
            if not lists:
                sheet.gap()
        elif name in ("li", "dd"):
            if step == "flat":
                sheet.end_line()
            else:
                lines = sheets.pop().done()
                mark = "  " if name == "dd" else marker(lists)
                if lines:
                    pad = " " * len(mark)
                    sheets[-1].raw([(mark if k == 0 else pad if x else "") + x for k, x in enumerate(lines)])
        elif name == "pre":
            pre -= 1
            sheet.gap()
        elif name in ("td", "th"):
            if step == "flat":
                sheet.text(" ")
            else:
                tables[-1][-1].append((sheets.pop().done(), *node.span))
        elif name == "caption" and step == "close":
            lines = sheets.pop().done()
            sheets[-1].raw(lines)
        elif name == "table":
            rows = tables.pop()
            if step == "close":
                stray = sheets.pop().done()  # text outside cells, and the caption, stand above
                sheets[-1].raw(stray + aligned(rows))
            sheets[-1].gap()
        elif name == "q":
            if not veiled[-1]:
                sheet.text('"')
        elif name in ("input", "textarea", "button"):
            sheet.text(" ")
        elif name in SPACED:
            sheet.gap()
        elif name in BLOCK:
            sheet.end_line()
        if node.shown is not None:
            veiled.pop()
    return "\n".join(sheets[0].done())


def marker(lists: list[list]) -> str:
    """The next item's bullet or number."""
    if not lists or lists[-1][0] != "ol":
        return "- "
    lists[-1][1] += 1
    return f"{lists[-1][1] - 1}. "


def extract(html: str | None) -> str:
    return render(build(html)) if html else ""


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts]), pa.array(texts, pa.string())],
            names=["page_id", "n_chars", "text_sha256", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, n_chars, text_sha256, text): one row per page; every page is rendered in place, nothing is shuffled."""
    C.prepared(pages)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(rows, "page_id long, n_chars long, text_sha256 string, text string")
