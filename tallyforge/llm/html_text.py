"""Layout-aware text of HTML pages.

A tokenizer and a tree builder that knows implied tags (unclosed p, li, td, tr, dt, option,
missing tr, unclosed head) make a tree; visibility rules drop what no reader sees; a
renderer writes the rest: a blank line around paragraphs and headings, a line for other
blocks, bullets and numbers for lists by depth, table cells in aligned columns, text of
``pre`` as it is and white space collapsed elsewhere. All visible text is written, in the
order of the page. Nothing recurses, so depth has no limit but memory.

Not visible: head, script, style, template, noscript, embedded media and their fallback,
annotations of formulas, of a drawing all but its ``text`` and ``foreignObject``, comments,
elements with ``hidden`` or a ``style`` of ``display:none``, all but the summary of a closed
``details``. Text is unseen where the nearest element that sets ``visibility`` hides it; a
child may be visible again.

Indentation ends at ``MOST_INDENT`` columns, and the place of an open element is looked up, not
searched for: a page costs time in proportion to its length, however deep it is.

Defined results: null html gives null text; empty html and html without visible text give
an empty one; malformed markup never fails; repeated rows give equal results; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import has_columns, released

#: An attribute by the states of HTML: a quote opens a value only right after "=", anywhere
#: else it is part of a name or of an unquoted value. A value may end with the page.
_PAIR = (
    r"([^\t\n\f\r />][^\t\n\f\r />=]*+)"
    r"(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\t\n\f\r >\"'][^\t\n\f\r >]*+))?+)?+"
)
_PAIRS = r"(?:[\t\n\f\r /]++|" + re.sub(r"\((?=[^?])", "(?:", _PAIR) + ")*+"
#: A comment, declaration or processing instruction; an end tag; a start tag with its
#: attributes (quoted values may hold ">").
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<\?[^>]*(?:>|\Z)|<[!/](?![a-zA-Z])[^>]*(?:>|\Z)|<![a-zA-Z][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\t\n\f\r />]*+)(" + _PAIRS + r")(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(_PAIR)
_WANTED = re.compile("hidden|style|span|start|value|open|type", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: A declaration; ";" within quotes or brackets doesn't end it.
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))++")
_HIDES = {"display": frozenset(("none",)), "visibility": frozenset(("hidden", "collapse"))}
#: Values besides those that hide; others are no values, and browsers pass over them.
_GLOBAL = frozenset("inherit initial unset revert revert-layer".split())
_INHERITS = _GLOBAL - {"initial"}
_SHOWS = {
    "visibility": _GLOBAL | {"visible"},
    "display": _GLOBAL | frozenset(
        "block inline inline-block flow flow-root flex inline-flex grid inline-grid table inline-table table-row-group "
        "table-header-group table-footer-group table-row table-cell table-column-group table-column table-caption "
        "list-item contents ruby ruby-base ruby-text run-in math -webkit-box -webkit-inline-box -webkit-flex".split()
    ),
}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object video audio canvas datalist noembed noframes title".split()
)
#: Parts of a drawing that aren't drawn in their place.
_UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc title".split())
#: HTML elements that end a drawing.
_LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
MOST_INDENT = 80
#: Sources of a formula, which readers don't see.
_NOTES = frozenset(("annotation", "annotation-xml"))
HEAD = frozenset("base link meta title style script noscript template".split())
#: Blocks with a blank line on either side, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset menu dir".split())
BLOCK = SPACED | frozenset(
    "html body address article aside details dialog dd div dt figcaption footer form header hgroup legend li main nav "
    "section summary center optgroup option caption thead tbody tfoot tr td th search".split()
)
CLOSES_P = BLOCK - frozenset("html body option optgroup caption thead tbody tfoot tr td th legend summary li dd dt".split()) | {"li", "dd", "dt"}
_CELLS, _SECTIONS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: A start tag ends these open elements, looked for up to the given boundaries.
_SCOPE = frozenset(("table", "td", "th", "caption", "button", "template", "body", "html"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir")) | _SCOPE),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | _SCOPE),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | _SCOPE),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup")) | _SCOPE),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",)) | _SCOPE),
    "td": (_CELLS | {"caption", "colgroup"}, frozenset(("table", "tr"))),
    "th": (_CELLS | {"caption", "colgroup"}, frozenset(("table", "tr"))),
    "tr": (_CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "thead": (_CELLS | _SECTIONS | {"tr", "caption", "colgroup"}, frozenset(("table",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",)) | _SCOPE),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",)) | _SCOPE),
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["thead"]
_TABLE_TAGS = _CELLS | _SECTIONS | {"tr", "table", "caption"}
_P, _TABLE, _END_BOUNDS = frozenset(("p",)), frozenset(("table",)), frozenset(("table", "td", "th", "caption"))
#: An unquoted value at the end of a tag: its "/" closes nothing.
_VALUE_END = re.compile(r"=[\t\n\f\r ]*[^\t\n\f\r \"'][^\t\n\f\r \"']*/\Z")


class Node:
    """An element: whether it has a box (``shown``), whether its own text is seen, and for
    elements of a drawing ``drawing``: 1, or 2 within its text."""

    __slots__ = ("tag", "attributes", "children", "shown", "seen", "drawing")

    def __init__(self, tag: str, attributes: dict[str, str], shown: bool, seen: bool, drawing: int = 0):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.shown, self.seen, self.drawing = shown, seen, drawing


class OpenElements:
    """The stack of open elements, and the places of each tag in it."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.places[self.nodes.pop().tag].pop()

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _bound(self, bounds: frozenset, but) -> int:
        return max((self.places[t][-1] for t in bounds if t not in but and self.places.get(t)), default=0)

    def close(self, tags: frozenset, bounds: frozenset) -> None:
        """Pop up to the outermost open element of ``tags`` within the boundaries."""
        held = [self.places[t] for t in tags if self.places.get(t)]
        if held:
            bound = self._bound(bounds, tags)
            found = [places[i] for places in held if (i := bisect_right(places, bound)) < len(places)]
            if found:
                self.cut(min(found))

    def pop_to(self, tag: str, bounds: frozenset) -> None:
        """Pop the innermost open element ``tag`` within the boundaries, and what is in it."""
        if self.has(tag) and self.places[tag][-1] > self._bound(bounds, (tag,)):
            self.cut(self.places[tag][-1])


def _attributes(source: str) -> dict[str, str]:
    if not _WANTED.search(source):
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _style(style: str) -> dict[str, str]:
    """The values of display and visibility that a style sets: of a property the last valid
    one counts, an important one before others."""
    won: dict[str, tuple[bool, str]] = {}
    for declaration in _DECLARATION.findall(_COMMENT.sub(" ", style)):
        name, _, value = declaration.lower().partition(":")
        name, (value, mark, important) = name.strip(), value.partition("!")
        if name not in _HIDES or mark and important.strip() != "important":
            continue
        words = value.split()
        hides = len(words) == 1 and words[0] in _HIDES[name]
        if not (hides or "var(" in value or words and _SHOWS[name].issuperset(words)):
            continue
        if mark or not won.get(name, (False, ""))[0]:
            won[name] = (bool(mark), " ".join(words))
    return {name: value for name, (_, value) in won.items()}


def _shown(tag: str, attributes: dict[str, str], style: dict[str, str]) -> bool:
    """Whether an element has a box: ``hidden`` gives way to a display that is set."""
    if tag in HIDDEN:
        return False
    return style["display"] != "none" if "display" in style else "hidden" not in attributes


def _seen(style: dict[str, str], before: bool) -> bool:
    """Whether text is seen, given what the parent says."""
    value = style.get("visibility")
    return before if value is None or value in _INHERITS or "var(" in value else value not in _HIDES["visibility"]


def parse(source: str) -> tuple[Node, str]:
    """The tree of a page, and the text of its first title."""
    root = Node("html", {}, True, True)
    stack = OpenElements(root)
    nodes, title, at, size = stack.nodes, None, 0, len(source)

    def text(part: str) -> None:
        if not part:
            return
        if nodes[-1].tag == "head" and not part.isspace():
            stack.cut(len(nodes) - 1)
        top = nodes[-1]
        if top.shown and top.seen and top.drawing != 1:
            top.children.append(html.unescape(part) if "&" in part else part)

    def push(tag: str, attributes: dict[str, str]) -> Node:
        node = child(tag, attributes)
        stack.push(node)
        return node

    def child(tag: str, attributes: dict[str, str]) -> Node:
        parent = nodes[-1]
        style = _style(attributes["style"]) if "style" in attributes else {}
        shown, drawing = parent.shown and _shown(tag, attributes, style), parent.drawing
        if tag == "svg":
            drawing = 1
        elif drawing:
            drawing = 2 if tag == "text" else 0 if tag == "foreignobject" else drawing
            shown = shown and tag not in _UNDRAWN
        elif tag in _NOTES and stack.has("math"):
            shown = False
        node = Node(tag, attributes, shown, _seen(style, parent.seen), drawing)
        parent.children.append(node)
        return node

    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                child("br", {})
            elif tag in ("html", "body"):
                pass
            elif tag in _TABLE_TAGS:
                stack.pop_to(tag, frozenset() if tag == "table" else _TABLE)
            else:
                stack.pop_to(tag, _END_BOUNDS)
            continue
        attributes = _attributes(m[3])
        if nodes[-1].tag == "head" and tag not in HEAD:
            stack.cut(len(nodes) - 1)
        if tag in ("html", "body"):
            style = _style(attributes.get("style", ""))
            nodes[-1].shown = nodes[-1].shown and _shown(tag, attributes, style)
            nodes[-1].seen = _seen(style, nodes[-1].seen)
            continue
        if nodes[-1].drawing and tag in _LEAVES:
            depth = len(nodes)
            while nodes[depth - 1].drawing:
                depth -= 1
            stack.cut(depth)
        if nodes[-1].drawing:
            if m[3].endswith("/") and not _VALUE_END.search(m[3]):
                child(tag, attributes)
                continue
        else:
            if tag in CLOSES_P:
                stack.close(_P, _SCOPE)
            if tag in IMPLIED:
                stack.close(*IMPLIED[tag])
            if tag in _CELLS and nodes[-1].tag != "tr" and stack.has("table"):
                push("tr", {})
            if tag in VOID:
                if tag in ("br", "hr", "wbr"):
                    child(tag, attributes)
                continue
        node = push(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\t\n\f\r />]){_PAIRS}>?", re.I).search(source, at)
            body = source[at : end.start() if end else size]
            at = end.end() if end else size
            if tag == "title" and title is None and not node.drawing:
                title = _SPACES.sub(" ", html.unescape(body)).strip()
            if node.shown and node.seen:
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            stack.cut(len(nodes) - 1)
    return root, title or ""


class Flow:
    """Text in lines: collapses white space, and the blank lines that blocks ask for."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next word
        self.blank = False  # a blank line is due before the next text
        self.indent = 0  # columns
        self.marker = ""  # of a list item, due before its text

    def words(self, text: str) -> None:
        parts = _SPACES.sub(" ", text)
        if parts[:1] == " ":
            self.space = True
            parts = parts[1:]
        if not parts:
            return
        ends = parts[-1] == " "
        if ends:
            parts = parts[:-1]
        self._begin()
        if self.space and self.line[-1:] and not self.line[-1].endswith("\n"):
            self.line.append(" ")
        self.line.append(parts)
        self.space = ends

    def literal(self, text: str) -> None:
        for i, part in enumerate(re.split("\r\n?|\n", text)):
            if i:
                self.brk()
            if part:
                self._begin()
                self.line.append(part)
        self.space = False

    def _begin(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = self.space = False
            before = min(MOST_INDENT, self.indent - len(self.marker))
            self.line += [" " * before, self.marker, ""]
            self.marker = ""

    def brk(self) -> None:
        """End the line; an empty one stays empty."""
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space, self.blank = [], False, False

    def end(self, spaced: bool) -> None:
        """End a block: the line, and a blank one if it is to be spaced."""
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.blank = self.blank or spaced

    def text(self) -> str:
        self.end(False)
        return "\n".join(self.lines).strip("\n").replace("\xa0", " ")


class Table:
    """Rows of cells; a cell is its lines, over so many columns and rows."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def lines(self) -> list[str]:
        grid: list[dict[int, tuple[list[str], int]]] = []
        taken: dict[int, int] = {}  # column -> rows it is still taken for
        for row in self.rows:
            cells, column = {}, 0
            after = {c: n - 1 for c, n in taken.items() if n > 1}
            for lines, wide, high in row:
                while column in taken:
                    column += 1
                cells[column] = (lines, wide)
                if high > 1:
                    after |= {c: high - 1 for c in range(column, column + wide)}
                column += wide
            taken = after
            grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for c, (lines, wide) in cells.items():
                if wide == 1:
                    width[c] = max(width.get(c, 0), *(len(x) for x in lines), 0)
        for c, lines, wide in sorted(((c, x, n) for cells in grid for c, (x, n) in cells.items() if n > 1), key=lambda x: x[2]):
            inner = sum(width.get(k, 0) for k in range(c, c + wide)) + 2 * (wide - 1)
            last = c + wide - 1  # what doesn't fit widens the last column that the cell spans
            width[last] = width.get(last, 0) + max(0, max(map(len, lines)) - inner)
            for k in range(c, last):
                width.setdefault(k, 0)
        out = list(self.caption)
        for cells in grid:
            for i in range(max((len(lines) for lines, _ in cells.values()), default=0)):
                line, at, begins = "", 0, {}
                for c in sorted(width | {c: 0 for c in cells}):
                    begins[c] = at
                    at += width.get(c, 0) + 2
                for c, (lines, _) in sorted(cells.items()):
                    part = lines[i] if i < len(lines) else ""
                    if part:
                        line = line.ljust(begins[c]) if len(line) <= begins[c] else line + "  "
                        line += part
                out.append(line)
        return out


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(1000, max(1, int(value))) if value.isascii() and value.isdigit() else 1


def render(root: Node) -> str:
    """Visible text of a tree."""
    flows = [Flow()]
    tables: list[Table] = []
    lists: list[list] = []  # [numbered, next number, indent before it]
    pre = 0
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.literal(node) if pre else flow.words(node)
            continue
        tag = node.tag
        if not leaving:
            if not node.shown:
                continue
            if tag == "br":
                if not node.seen:
                    continue
                flow._begin() if flow.blank else None
                flow.brk()
                continue
            if tag == "wbr":
                continue
            if tag in BLOCK or node.drawing and tag == "text":
                nested = lists and tag in ("ul", "ol", "menu", "dir")
                flow.end(tag in SPACED and not nested)
            if node.drawing:
                pass
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, flow.indent])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    value = node.attributes.get("value", "")
                    if re.fullmatch(r"-?\d{1,9}", value):
                        lists[-1][1] = int(value)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                base = lists[-1][2] if lists else flow.indent
                flow.marker, flow.indent = mark if node.seen else "", base + len(mark)
            elif tag == "dd" or tag == "blockquote":
                flow.indent += 2
            elif tag == "pre" or tag == "textarea" or tag == "xmp":
                pre += 1
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif (tag in _CELLS or tag == "caption") and tables:
                flows.append(Flow())
            elif tag == "hr":
                continue
            todo.append((node, True))
            shut = tag == "details" and "open" not in node.attributes
            for child in reversed(node.children):
                if shut and (isinstance(child, str) or child.tag != "summary"):
                    continue
                todo.append((child, False))
            continue
        if node.drawing:
            if tag == "text":
                flow.end(False)
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            flow.end(False)
            flow.indent = lists.pop()[2]
        elif tag == "li":
            flow.end(False)
            flow.marker, flow.indent = "", lists[-1][2] if lists else 0
        elif tag == "dd" or tag == "blockquote":
            flow.end(False)
            flow.indent -= 2
        elif tag == "pre" or tag == "textarea" or tag == "xmp":
            pre -= 1
        elif tag == "table":
            table = tables.pop()
            for line in table.lines():
                flow.literal(line)
                flow.brk() if not line else flow.end(False)
        elif (tag in _CELLS or tag == "caption") and tables:
            held = flows.pop().text().split("\n")
            if tag == "caption":
                tables[-1].caption += held
            else:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((held, _span(node, "colspan"), _span(node, "rowspan")))
            continue
        if tag in BLOCK:
            nested = lists and tag in ("ul", "ol", "menu", "dir")
            flow.end(tag in SPACED and not nested)
    return flows[0].text()


def extract(source: str) -> tuple[str, str]:
    """Title and visible text of a page."""
    root, title = parse(source.replace("\x00", "�"))
    return title, render(root)


DDL = "page_id long, url string, title string, text string"


def _text_rows(batches):
    for b in batches:
        titles, texts = [], []
        for source in b.column("html"):
            source = source.as_py()
            title, text = (None, None) if source is None else extract(source)
            titles.append(title)
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(titles, pa.string()), pa.array(texts, pa.string())],
            names=["page_id", "url", "title", "text"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, title, text."""
    rows = has_columns(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(released(_text_rows), DDL)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
