"""Layout-aware text of web pages.

A tokenizer and a tree builder with implied tags (a block ends an open
paragraph, ``li``, ``dt``/``dd``, ``option``, table rows and cells end their
like, an unmatched end tag is ignored, open elements end with the page)
make a tree; the renderer walks it without recursion and emits all visible
text: blank lines around paragraphs, headings, lists and tables, new lines
around other blocks, bullets and numbers with indents for lists, ``pre`` as
it stands, and table cells in aligned columns (``colspan`` and ``rowspan``
hold their columns). Not visible: head, script, style, template, noscript and
the like, comments, and elements that ``hidden`` or an inline ``display:none``
or ``visibility:hidden`` hides.

Defined results: null or empty pages give empty text; a page cut off inside
a tag loses that tag only; character references are resolved, also without
a semicolon where HTML allows it; repeated rows give repeated rows; columns
other than the id, the url and the page are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Element classes of HTML; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist".split())
#: Not shown inside a drawing or a formula; of a drawing only what stands in a text element is.
DRAWN_UNSEEN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
DRAWN_TEXT = ("text", "foreignobject")
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure hr fieldset menu".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav option optgroup search section summary caption tr thead tbody tfoot".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt xmp".split())
#: Start tag: the open elements it ends, and where looking for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
WALLS = frozenset("table td th caption button object html".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title head".split())
#: A column is not padded beyond this width.
WIDEST = 120

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
HIDES = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")
BLANKS = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("tag", "attributes", "children", "unseen")

    def __init__(self, tag: str, attributes: str = "", unseen: bool = False):
        self.tag = tag
        self.attributes = attributes
        self.unseen = unseen
        self.children: list[Element | str] = []

    def get(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def number(self, name: str, default: int, most: int = 1000) -> int:
        x = (self.get(name) or "").strip()
        return min(most, int(x)) if re.fullmatch(r"-?\d{1,6}", x) else default

    def hidden(self) -> bool:
        if self.unseen or self.tag in UNSEEN:
            return True
        if not self.attributes or ("hid" not in self.attributes.lower() and "none" not in self.attributes.lower() and "collapse" not in self.attributes.lower()):
            return False
        return self.get("hidden") is not None or HIDES.search(self.get("style") or "") is not None or (self.tag == "input" and self.get("type") == "hidden")


def parse(page: str) -> Element:
    """The tree of a page."""
    root = Element("#page")
    stack = [root]
    open_: dict[str, int] = {}

    def pop() -> None:
        tag = stack.pop().tag
        open_[tag] -= 1

    def end(tags, walls) -> None:
        """End the open elements from the outermost of ``tags`` that no wall hides."""
        if not any(open_.get(t) for t in tags):
            return
        at = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                at = i
            elif stack[i].tag in walls:
                break
        while at is not None and len(stack) > at:
            pop()

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if open_.get("head") and text.strip():
                    end({"head"}, ())
                if not open_.get("svg") or any(open_.get(t) for t in DRAWN_TEXT):
                    stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_.get("p"):
                stack[-1].children.append(Element("p"))
            elif tag == "br":
                stack[-1].children.append(Element("br"))
            elif open_.get(tag) and tag not in ("html", "body"):
                walls = () if tag in WALLS else WALLS - {"html"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in walls:
                        break
            continue
        if tag in ("html", "body") and open_.get(tag):
            continue
        if open_.get("head") and tag not in HEAD_ONLY:
            end({"head"}, ())
        if tag in ENDS_P and open_.get("p"):
            end({"p"}, WALLS)
        if tag in ENDS:
            end(*ENDS[tag])
        drawn = tag in DRAWN_UNSEEN and (open_.get("svg") or open_.get("math"))
        new = Element(tag, m[3], bool(drawn))
        stack[-1].children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : close.start() if close else size]
            at = close.end() if close else size
            if tag == "textarea":
                new.children.append(html.unescape(body))
            elif tag == "xmp":
                new.children.append(body)
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS and tag not in VOID:
            stack.append(new)
            open_[tag] = open_.get(tag, 0) + 1
    return root


class Flow:
    """Lines of text under construction; ``gap``: line breaks wanted before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.indents = [""]
        self.marker: str | None = None
        self.fresh = True  # at the start of a line

    def block(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def _begin(self) -> None:
        if self.parts and self.gap:
            self.parts.append("\n" * (self.gap - self.fresh))  # a break before it is part of the gap
            self.fresh = True
        self.gap = 0
        if self.fresh:
            self.parts.append(self.marker if self.marker is not None else self.indents[-1])
            self.marker = None
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.fresh = False

    def text(self, s: str) -> None:
        words = BLANKS.sub(" ", s)
        body = words.strip(" ")
        if not body:
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        self._begin()
        self.parts.append(body)
        self.space = words[-1] == " "

    def line_break(self) -> None:
        if self.gap == 0 and self.parts:
            self.parts.append("\n")
            self.fresh = True
        self.space = False

    def verbatim(self, s: str) -> None:
        lines = s.replace("\r\n", "\n").split("\n")
        for i, line in enumerate(lines):
            if i:
                self._begin() if self.gap else None
                self.parts.append("\n")
                self.fresh = True
            if line:
                self._begin()
                self.parts.append(line)

    def done(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.parts).split("\n")).strip("\n")


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines, columns, rows of each cell

    def lines(self) -> list[str]:
        grid: list[dict[int, list[str]]] = []
        spans: list[list[tuple[int, int]]] = []  # per row: first column and columns of each cell
        held: dict[int, int] = {}
        for row in self.rows:
            line, cells, col = {}, [], 0
            for text, wide, tall in row:
                while held.get(col, 0) > 0:
                    col += 1
                line[col] = text
                cells.append((col, wide))
                for c in range(col, col + wide):
                    held[c] = tall
                col += wide
            held = {c: n - 1 for c, n in held.items() if n > 1}
            grid.append(line)
            spans.append(cells)
        width: dict[int, int] = {}
        for line, cells in zip(grid, spans):
            for col, wide in cells:
                if wide == 1:
                    width[col] = max(width.get(col, 0), min(WIDEST, max(map(len, line[col]), default=0)))
        out = []
        for line, cells in zip(grid, spans):
            for k in range(max((len(line[c]) for c, _ in cells), default=0)):
                s, at = "", 0
                for col, _ in cells:
                    while at < col:
                        s += " " * max(0, sum(width.get(c, 0) + 2 for c in range(at, col)) - (len(s) - sum(width.get(c, 0) + 2 for c in range(at))))
                        at = col
                    s += line[col][k] if k < len(line[col]) else ""
                out.append(s.rstrip())
        return out


def render(root: Element) -> str:
    """All visible text of a tree."""
    flows = [Flow()]
    tables: list[Table] = []
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    todo: list[tuple[Element | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.verbatim(node) if pre else flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden():
                continue
            if tag == "br":
                flow.line_break()
                continue
            if tag in ("td", "th") and tables:
                flows.append(Flow())
                if not tables[-1].rows:
                    tables[-1].rows.append([])
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in BLOCKS:
                flow.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", node.number("start", 1, 10**6)])
            elif tag == "li":
                if lists and lists[-1][0]:
                    mark = f"{node.number('value', lists[-1][1], 10**6)}. "
                    lists[-1][1] = node.number("value", lists[-1][1], 10**6) + 1
                else:
                    mark = "* "
                flow.marker = flow.indents[-1] + mark
                flow.indents.append(flow.indents[-1] + " " * len(mark))
            elif tag in ("dd", "blockquote"):
                flow.indents.append(flow.indents[-1] + "  ")
            elif tag == "table":
                tables.append(Table())
            elif tag in ("pre", "xmp"):
                pre += 1
                if tag == "pre" and node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                    node.children[0] = node.children[0][1:]
            todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
            continue
        if tag in ("td", "th") and tables:
            cell = flows.pop().done()
            tables[-1].rows[-1].append((cell.split("\n") if cell else [""], max(1, node.number("colspan", 1)), max(1, node.number("rowspan", 1))))
            continue
        if tag == "table":
            for line in tables.pop().lines():
                flow.block(1)
                if line:
                    flow._begin()
                    flow.parts.append(line)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            flow.indents.pop()
            if tag == "li":
                flow.marker = None
        elif tag in ("pre", "xmp"):
            pre -= 1
        if tag in BLOCKS and tag != "tr":
            flow.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
    return flows[0].done()


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """(id, *carry, text) of every page."""
    carry = carry or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [page_text(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(text, pa.string())], names=[id_col, *carry, "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *carry)) + ", text string"
    return map_batches(pages.select(id_col, html_col, *carry), run, schema)
