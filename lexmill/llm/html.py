"""HTML to text with its layout: tree building with implied tags, then rendering.

The tree builder knows void and raw-text elements and closes elements whose end is implied.
Rendering leaves out what a browser doesn't show (head, scripts, hidden elements, all but the
summary of closed details, options that aren't chosen), keeps blocks on lines of their own and
paragraphs apart by a blank line, indents and marks list items, and pads table cells to
columns, also under cells that span columns or rows.

Time and output are linear in the markup. So items and quotes are indented up to ``LEVELS``
deep, spans reach up to ``COLUMNS``, and tables inside more than ``TABLES`` others run on as
blocks. Columns are aligned up to a width that halves, from ``WIDEST`` on, until a table's
lines take no more than ``FILL`` times its cells' text and tags; a table for which none is
narrow enough has its cells one after the other.

Defined results: null and empty html give empty text; ill-formed markup never fails: stray
end tags are dropped, open elements end with their parent, and open quotes and comments reach
to the end; repeated rows are rendered each for itself; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes rp video audio canvas datalist annotation annotation-xml desc metadata defs".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option search section summary tr td th thead tbody tfoot caption".split()
)
#: Which open elements a start tag closes, and the elements that stop the search for them.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
CLOSES_P = (BLOCKS - frozenset("html body dt dd li tr td th thead tbody tfoot caption option optgroup legend".split())) | {"li", "dd", "dt"}
FENCES = frozenset("table td th caption button".split())  # a paragraph outside these isn't closed from inside
LISTS = frozenset("ul ol menu dir".split())
LEVELS, WIDEST, COLUMNS, TABLES, FILL = 20, 200, 1000, 20, 12
HEAD_ONLY = frozenset("title base link meta script style noscript template".split())

_MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_WHITE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def parse(source: str) -> Node:
    """The tree of a page; its root stands above ``html``."""
    root = Node("#root", {})
    open_: list[Node] = [root]
    names: list[str] = ["#root"]
    places: dict[str, list[int]] = {}  # where elements of a name are open

    def close_to(depth: int) -> None:
        while len(names) > depth:
            places[names.pop()].pop()
            open_.pop()

    def last(wanted, stop=frozenset()) -> int:
        """The innermost open element of the wanted ones, if no stop stands inside it."""
        found = max([p[-1] for n in wanted if (p := places.get(n))], default=0)
        return found if found and found >= max([p[-1] for n in stop if (p := places.get(n))], default=0) else 0

    at = 0
    while True:
        m = _MARKUP.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            if names[-1] == "head" and not text.isspace():
                close_to(len(names) - 1)  # text implies the body
            open_[-1].children.append(entities.unescape(text))
        if not m:
            return root
        at = m.end()
        ending, name = m[1], m[2]
        if ending:
            ending = ending.lower()
            if ending == "br":
                open_[-1].children.append(Node("br", {}))
            elif ending == "p" and not last({"p"}, FENCES):
                open_[-1].children.append(Node("p", {}))
            elif depth := last({ending}, FENCES - {ending} if ending not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {ending}):
                close_to(depth)
        elif name:
            name = name.lower()
            if name in ("html", "head", "body") and places.get(name):
                continue
            if names[-1] == "head" and name not in HEAD_ONLY and name != "head":
                close_to(len(names) - 1)
            if name in CLOSES_P and (depth := last({"p"}, FENCES)):
                close_to(depth)
            if name in CLOSED_BY:
                ends, stop = CLOSED_BY[name]
                while depth := last(ends, stop):
                    close_to(depth)
            elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", names[-1]):
                close_to(len(names) - 1)
            node = Node(name, _attributes(m[3]) if m[3].strip(" /\t\r\n") else {})
            open_[-1].children.append(node)
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                body = source[at : end.start() if end else len(source)]
                node.children.append(entities.unescape(body) if name in ("textarea", "title") else body)
                at = end.end() if end else len(source)
                continue
            places.setdefault(name, []).append(len(names))
            open_.append(node)
            names.append(name)


def visible(node: Node) -> bool:
    """Whether an element has a place on the page; its text may still be hidden."""
    if node.name in HIDDEN or (node.name == "dialog" and "open" not in node.attributes):
        return False
    return "hidden" not in node.attributes and not _GONE.search(node.attributes.get("style", "")) if node.attributes else True


def seen(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is shown: as around it, unless the element says otherwise."""
    said = _VISIBILITY.findall(node.attributes.get("style", "")) if node.attributes else ()
    return said[-1].lower() == "visible" if said else inherited


def field_text(node: Node) -> str:
    kind = node.attributes.get("type", "").lower().strip()
    if node.name == "img" or kind == "image":
        return node.attributes.get("alt", "")
    # A kind that isn't known is a text field.
    return "" if kind in ("hidden", "password", "checkbox", "radio", "file", "range", "color") else node.attributes.get("value", "")


def width(text: str) -> int:
    """Columns that a text takes: wide characters count twice, combining marks not at all."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines as they are laid out. ``gap`` blank lines come before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.prefixes: list[str] = [""]
        self.marker: str | None = None

    def indent(self, columns: int) -> None:
        self.prefixes.append(self.prefixes[-1] + " " * columns if len(self.prefixes) <= LEVELS else self.prefixes[-1])

    def end_line(self) -> None:
        if self.now:
            line = "".join(self.now).rstrip()
            if self.lines:
                self.lines += [""] * self.gap
            prefix = self.prefixes[-1]
            if self.marker is not None:
                prefix = self.prefixes[-2] + self.marker
                self.marker = None
            self.lines.append(prefix + line)
            self.gap = 0
        self.now, self.space = [], False

    def block(self, gap: int = 0) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def text(self, text: str) -> None:
        if not text:
            return
        for i, run in enumerate(_WHITE.split(text)):
            if i:
                self.space = True
            if run:
                if self.space and self.now:
                    self.now.append(" ")
                self.space = False
                self.now.append(run)

    def verbatim(self, text: str) -> None:
        first, *more = text.replace("\r\n", "\n").split("\n")
        if first:
            self.now.append(first)
        for line in more:
            if self.now:
                self.end_line()
            else:
                self.gap += 1
            if line:
                self.now.append(line)


def render(top: Node, depth: int = 0, shown_around: bool = True) -> str:
    """Visible text of a tree. ``depth`` counts tables around it; far inside, cells run on as blocks."""
    page = Page()
    todo: list[tuple] = [("open", top, False, shown_around)]
    lists: list[list] = []
    while todo:
        what, node, pre, show = todo.pop()
        if what == "close":
            name = node.name
            if name == "li" or name == "dd" or name == "blockquote":
                page.end_line()
                page.marker = None
                page.prefixes.pop()
            if name in LISTS:
                lists.pop()
            if name == "q" and show:
                page.text("”")
            if name in BLOCKS:
                page.block(1 if name in PARAGRAPHS and not (name in ("ul", "ol") and lists) else 0)
            continue
        if isinstance(node, str):
            if show:
                page.verbatim(node) if pre else page.text(node)
            continue
        if not visible(node):
            continue
        name, show = node.name, seen(node, show)
        if name == "br":
            if page.now:
                page.end_line()
            elif page.lines:
                page.gap = max(page.gap, 1)
            continue
        if name == "hr":
            page.block(1)
            continue
        if name == "img" or name == "input":
            if show and (shown := field_text(node)):
                page.text(f" {shown} ")
            continue
        if name == "select":
            for shown in options(node) if show else ():
                page.text(f" {shown} ")
            continue
        if name == "table" and depth < TABLES:
            page.block(1)
            for line in table(node, depth, show).split("\n"):
                if line:
                    page.now.append(line)
                    page.end_line()
            page.block(1)
            continue
        if name in BLOCKS:
            page.block(1 if name in PARAGRAPHS and not (name in ("ul", "ol") and lists) else 0)
        if name in LISTS:
            start = node.attributes.get("start", "1")
            lists.append([name == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif name == "li":
            page.end_line()
            if lists and lists[-1][0]:
                page.marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.marker = "- "
            page.indent(len(page.marker))
        elif name == "dd" or name == "blockquote":
            page.indent(2)
        elif name == "q" and show:
            page.text("“")
        todo.append(("close", node, pre, show))
        inner = pre or name in ("pre", "textarea", "xmp")
        shown = node.children
        if name == "details" and "open" not in node.attributes:
            shown = [c for c in shown if isinstance(c, Node) and c.name == "summary"][:1]
        todo.extend(("open", child, inner, show) for child in reversed(shown))
    page.end_line()
    return "\n".join(page.lines)


def options(node: Node) -> list[str]:
    """What a selection shows: its chosen options, or the first; all of them in an open list."""
    found, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, Node) and visible(child):
            if child.name == "option":
                found.append(child)
            else:
                todo.extend(reversed(child.children))
    size = node.attributes.get("size", "1")
    if "multiple" not in node.attributes and not (size.isdecimal() and size.isascii() and int(size[:9]) > 1):
        found = [o for o in found if "selected" in o.attributes][-1:] or found[:1]
    return [_words(o) for o in found]


def _words(node: Node) -> str:
    """All text inside, of whatever elements."""
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif visible(item):
            todo.extend(reversed(item.children))
    return "".join(out).strip()


def _span(cell: Node, name: str) -> int:
    said = cell.attributes.get(name, "1")
    return max(1, min(int(said[:6]), 1 << 16)) if said.isdecimal() and said.isascii() else 1


def table(node: Node, depth: int, show: bool = True) -> str:
    """A table's captions, then its rows; cells of a column begin at the same place."""
    captions, rows = [], []
    below: dict[int, int] = {}  # columns that a cell above spans, and how many rows more
    todo = [(c, show) for c in reversed(node.children)]
    while todo:
        child, show = todo.pop()
        if isinstance(child, str):
            if show and child.strip():
                captions.append(child.strip())
            continue
        if not visible(child):
            continue
        show = seen(child, show)
        if child.name == "caption":
            captions.append(render(_inside(child), depth + 1, show))
        elif child.name == "tr":
            cells: list[str] = []
            ahead: dict[int, int] = {}

            def skip(cells=cells, ahead=ahead) -> None:
                while (more := below.get(len(cells))) is not None:
                    if more > 1:
                        ahead[len(cells)] = more - 1
                    cells.append("")

            for cell in child.children:
                skip()
                if isinstance(cell, Node) and visible(cell):
                    wide, high = min(_span(cell, "colspan"), max(1, COLUMNS - len(cells))), _span(cell, "rowspan")
                    if high > 1 and len(cells) < COLUMNS:
                        ahead |= dict.fromkeys(range(len(cells), len(cells) + wide), high - 1)
                    cells += [render(_inside(cell), depth + 1, seen(cell, show)), *[""] * (wide - 1)]
                elif isinstance(cell, str) and show and cell.strip():
                    cells.append(cell.strip())
            skip()
            below = ahead | {c: n - 1 for c, n in below.items() if c >= len(cells) and n > 1}
            rows.append([c.split("\n") for c in cells])
        elif child.name in ("thead", "tbody", "tfoot", "colgroup"):
            todo.extend((c, show) for c in reversed(child.children))
        else:
            captions.append(render(child, depth + 1, show))
    return "\n".join([*filter(None, captions), *_aligned(rows)])


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Lines of cells that are lists of lines. Columns are as wide as ``FILL`` allows."""
    # Each line of a row by what stands in it: (column, text), so that empty cells cost nothing.
    lines: list[list[tuple[int, str]]] = []
    most: list[int] = []
    room = 0
    for row in rows:
        most += [0] * (len(row) - len(most))
        own: list[list[tuple[int, str]]] = []
        for i, cell in enumerate(row):
            room += 4 * FILL
            for k, text in enumerate(cell):
                if k == len(own):
                    own.append([])
                if text:
                    own[k].append((i, text))
                    most[i] = max(most[i], width(text))
                room += FILL * (len(text) + 4)
        lines += own
    widest = WIDEST
    while widest:
        begins = [0]
        for w in most:
            begins.append(begins[-1] + min(w, widest) + 3)
        if sum(begins[line[-1][0]] + len(line[-1][1]) for line in lines if line) <= room:
            blank = "".join(" " * min(w, widest) + " | " for w in most)
            return [_line(line, begins, blank) for line in lines]
        widest //= 2
    return [" | ".join(text for _, text in line) for line in lines]


def _line(line: list[tuple[int, str]], begins: list[int], blank: str) -> str:
    out, at = [], 0  # the column to come
    for i, text in line:
        out += [blank[begins[at] : begins[i]], text]
        if (i, text) != line[-1]:
            out.append(" " * (begins[i + 1] - 3 - begins[i] - width(text)) + " | ")
        at = i + 1
    return "".join(out).rstrip()


def _inside(cell: Node) -> Node:
    """A cell's content without the cell's own block."""
    inner = Node("#cell", {})
    inner.children = cell.children
    return inner


def to_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text, n_chars, n_lines)`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())],
                ["id", "text", "n_chars", "n_lines"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"id {kind}, text string, n_chars long, n_lines long").withColumnRenamed("id", id_col)
