"""Layout-aware text of HTML pages: a tokeniser, a tree builder, visibility rules and a renderer.

The tokeniser follows the states of the HTML standard for tags, attributes and comments; a tag that the
page's end cuts off is dropped, as the standard has it. The tree builder supplies the end tags that HTML
leaves out (paragraphs before blocks, list items, definition terms, table rows and cells, options), ignores
end tags that match nothing, closes what is open at the end and puts head content where it belongs. No
nesting is too deep: it finds open elements by name, and the renderer keeps a stack of its own.

Not visible are the head, scripts, styles, templates and embedded fallbacks, comments, elements with
``hidden`` or ``display:none``, closed dialogs, all of a closed ``details`` but its summary, and text whose
inherited ``visibility`` is hidden or collapse. Inline styles are split into declarations; the last valid
one of a property counts, ``!important`` first, and ``display`` overrides ``hidden``. A quote that no
second one closes is an ordinary character there. Everything else is emitted, also the labels of buttons,
the values of text fields and the alternative texts of images.

Rendering: white space collapses outside ``pre`` and ``textarea``; blocks begin on a new line, paragraphs,
headings, lists, quotes and tables with a blank line around them; list items have a dash or their number
(``start``, ``reversed``, ``value`` and ``type`` are observed) and nested lists are indented, as quotes are;
table cells are padded so that columns align, cells of several lines keep their lines, and ``colspan`` and
``rowspan`` are observed. A table whose columns take more than ALIGNED characters together is not aligned: a line has
what the row's cells have there, only separated. Indentation stops growing at INDENT columns, and a table within
more than TABLES others has its cells one below the other. So what layout adds is bounded by a number of
characters for each line of text and each level of lists and quotes, never by a product of a page's parts.

Edge cases: a null page has a null text, an empty one or one without visible text an empty text; repeated
rows are rendered each; other columns are ignored, a kept column named ``text`` gives way to the result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDENT, TABLES, ALIGNED = 200, 50, 240

# The element classes of the HTML standard, and the keywords of display.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
HEAD = frozenset("base link meta title style script noscript template".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist rp title progress meter annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure fieldset form details hr xmp listing".split())
LINED = frozenset("address article aside body center dd dialog div dt figcaption footer header hgroup html legend li main nav optgroup option search section summary caption tr textarea select".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul xmp listing dd dt li".split())
#: For a start tag: the open elements that it ends, and those that a search for them does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Elements that an end tag from inside does not reach past.
WALLS = frozenset("table td th caption".split())
SECTIONS = ("thead", "tbody", "tfoot")
DISPLAYS = frozenset(
    "block inline inline-block flex inline-flex grid inline-grid flow flow-root contents list-item run-in ruby ruby-base ruby-text math table inline-table table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group none initial inherit unset revert revert-layer".split()
)
VISIBILITIES = {"visible": True, "initial": True, "hidden": False, "collapse": False, "inherit": None, "unset": None, "revert": None, "revert-layer": None}
#: Input types that show their value.
FIELDS = frozenset(["", *"text search tel url email number date month week time datetime-local submit reset button".split()])

_WS = " \t\n\r\f"
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_GAP = re.compile(r"[\t\n\f\r /]*")
#: A name, and a value of one of three kinds; a quote that isn't closed runs to the page's end.
_ATTRIBUTE = re.compile(r"([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|(?=>)|([\"'])|([^\t\n\f\r >]+)))?")
_COMMENT_END = re.compile(r"--!?>")
#: What a style is cut into: comments, strings, escapes, brackets, ends of declarations.
_STYLE = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\\.|[()\[\]{};]|[^\\()\[\]{};/\"']+|.", re.S)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """(attributes, end, self-closing) of a tag whose name ends at ``at``; None if the page ends within it."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= n:
            return None
        if page[at] == ">":
            return found, at + 1, gap.group().endswith("/")
        m = _ATTRIBUTE.match(page, at)
        if m[4]:
            return None
        at = m.end()
        value = m[2] or m[3] or m[5] or ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)


def tokens(page: str):
    """("text", text), ("start", name, attributes, self-closing, end of the tag) and ("end", name); a consumer may send the place to go on at."""
    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", page[at:]
            return
        after = page[tag + 1 : tag + 2]
        closing = after == "/"
        name = _NAME.match(page, tag + 1 + closing) if after else None
        if not name and not closing and after not in ("!", "?") or closing and tag + 2 >= n or not after:
            yield "text", page[at : tag + 1]  # a less-than sign of the text
            at = tag + 1
            continue
        if tag > at:
            yield "text", page[at:tag]
        if name:
            if (read := _attributes(page, name.end())) is None:
                return
            attrs, at, bare = read
            if closing:
                yield "end", name.group().lower()
            elif (to := (yield "start", name.group().lower(), attrs, bare, at)) is not None:
                at = to
                yield None
        elif page.startswith("!--", tag + 1):
            if page.startswith(("!-->", "!--->"), tag + 1):
                at = page.index(">", tag) + 1
            else:
                end = _COMMENT_END.search(page, tag + 4)
                at = end.end() if end else n
        else:
            end = page.find(">", tag)
            at = end + 1 if end >= 0 else n


class _Tree:
    """The open elements, found by name without walking the stack."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.body: Node | None = None

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node, attach: bool = True) -> None:
        if attach:
            self.top.children.append(node)
        self.places[node.name].append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().name].pop()

    def nearest(self, names) -> int:
        return max((p[-1] for x in names if (p := self.places.get(x))), default=0)

    def close(self, names, stop) -> None:
        """Ends the nearest open element of those names and all within it, unless one of ``stop`` is nearer."""
        place = self.nearest(names)
        if place and place >= self.nearest(stop):
            self.cut(place)

    def enter_body(self) -> None:
        """Leaves the head and opens the body if need be."""
        self.cut(1)
        if self.body is None:
            self.body = Node("body", {})
            self.push(self.body)
        else:
            self.push(self.body, attach=False)


def parse(page: str) -> Node:
    """The tree of a page; its root is ``html``."""
    tree, n = _Tree(), len(page)
    stream = tokens(page)
    for token in stream:
        if token[0] == "text":
            text = token[1]
            if tree.top.name in ("html", "head"):
                if not text.strip(_WS):
                    continue
                tree.enter_body()
            tree.top.children.append(html.unescape(text) if "&" in text else text)
        elif token[0] == "start":
            _, name, attrs, bare, at = token
            if name == "html":
                tree.root.attrs = {**attrs, **tree.root.attrs}
                continue
            if name in ("head", "body"):
                if name == "head" and len(tree.stack) == 1 and not tree.root.children:
                    tree.push(Node("head", attrs))
                elif name == "body" and tree.body is None:
                    tree.enter_body()
                    tree.body.attrs = attrs
                continue
            if tree.top.name in ("html", "head"):
                if name in HEAD and tree.body is None:
                    if tree.top.name == "html":
                        tree.push(Node("head", {}))
                else:
                    tree.enter_body()
            if name in CLOSES_P and tree.places.get("p"):
                tree.close({"p"}, WALLS | {"button", "object"})
            if name in ENDS:
                ends, stop = ENDS[name]
                for _ in range(3):  # a row ends cell and row, a section also the section before it
                    tree.close(ends, stop)
            node = Node(name, attrs)
            foreign = bool(tree.places.get("svg") or tree.places.get("math"))
            if name in RAW and not foreign:
                tree.top.children.append(node)
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at) if name != "plaintext" else None
                if inner := page[at : end.start() if end else n]:
                    node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
                stream.send(end.end() if end else n)
            elif name in VOID or bare and (foreign or name in ("svg", "math")):
                tree.top.children.append(node)
            else:
                tree.push(node)
        else:
            name = token[1]
            if name == "br":
                tree.top.children.append(Node("br", {}))
            elif name == "p" and not tree.places.get("p"):
                tree.top.children.append(Node("p", {}))
            elif name == "head":
                if tree.top.name == "head":
                    tree.cut(len(tree.stack) - 1)
            elif name not in ("html", "body"):
                tree.close({name}, {"table"} - {name} if name in ("table", "tr", *SECTIONS) else WALLS - {name})
    return tree.root


# ---------------------------------------------------------------- visibility


def declarations(style: str) -> dict[str, list[str]]:
    """The values of ``display`` and ``visibility`` in a style, those that count most last."""
    found: dict[str, list[str]] = {"display": [], "visibility": []}
    urgent: dict[str, list[str]] = {"display": [], "visibility": []}
    depth, parts = 0, []

    def finish():
        name, colon, value = "".join(parts).partition(":")
        name, value = name.strip(_WS).lower(), value.strip(_WS).lower()
        if colon and name in found:
            plain = re.sub(r"[ \t\n\r\f]*![ \t\n\r\f]*important$", "", value)
            (urgent if plain != value else found)[name].append(plain)
        parts.clear()

    for m in _STYLE.finditer(style):
        t = m.group()
        if t.startswith("/*"):
            continue
        if t == ";" and not depth:
            finish()
            continue
        depth = max(depth + (t in "([{") - (t in ")]}"), 0) if len(t) == 1 else depth
        parts.append(t)
    finish()
    return {k: found[k] + urgent[k] for k in found}


def displayed(node: Node, style: dict[str, list[str]]) -> bool:
    """Whether an element takes part in the layout."""
    a = node.attrs
    if node.name in UNSEEN or node.name == "input" and a.get("type", "").lower() == "hidden":
        return False
    for value in reversed(style["display"]):
        words = value.split()
        if words and DISPLAYS.issuperset(words):
            return words != ["none"]
    return not ("hidden" in a and a["hidden"].lower() != "until-found" or node.name == "dialog" and "open" not in a)


_PLAIN_STYLE: dict[str, list[str]] = {"display": [], "visibility": []}


def look(node: Node, seen: bool) -> tuple[bool, bool]:
    """(takes part in the layout, its text is visible) of an element within one whose text is visible or not."""
    style = declarations(node.attrs["style"]) if node.attrs.get("style") else _PLAIN_STYLE
    for value in reversed(style["visibility"]):
        if value in VISIBILITIES:
            if value == "collapse" and node.name in ("tr", *SECTIONS):
                return False, False
            own = VISIBILITIES[value]
            seen = seen if own is None else own
            break
    return displayed(node, style), seen


# ---------------------------------------------------------------- lines


def width(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text, with collapsing white space and margins."""

    def __init__(self):
        self.lines: list[str] = []
        self._parts: list[str] = []
        self._blank = False  # a collapsed blank is due before the next word
        self._margin = 0  # blank lines due before the next line
        self._indents: list[int] = [0]
        self._marks: list[tuple[int, str]] = []  # columns and marks of list items that have no line yet

    @property
    def nested(self) -> bool:
        return len(self._indents) > 1

    def _end(self) -> None:
        if self._parts:
            text = "".join(self._parts).rstrip(" ")
            self._parts = []
            self._emit(text)
        self._blank = False

    def _emit(self, text: str) -> None:
        indent = ""
        for column, mark in self._marks:
            indent = indent.ljust(min(column, INDENT)) + mark
        self._marks = []
        indent = indent.ljust(min(self._indents[-1], INDENT))
        if self.lines:
            self.lines += [""] * self._margin
        self._margin = 0
        self.lines.append((indent + text).rstrip(" "))

    def block(self, margin: int) -> None:
        self._end()
        self._margin = max(self._margin, margin)

    def text(self, s: str) -> None:
        for k, word in enumerate(_BLANKS.split(s)):
            if k and self._parts:
                self._blank = True
            if word:
                if self._blank:
                    self._parts.append(" ")
                    self._blank = False
                self._parts.append(word)

    def preformatted(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self._parts.append(first)
        for line in rest:
            self.line_break()
            self._parts.append(line)

    def line_break(self) -> None:
        if self._parts:
            self._end()
        else:
            self._emit("")

    def whole(self, lines: list[str]) -> None:
        self._end()
        for line in lines:
            self._emit(line)

    def indent(self, by: int, mark: str = "") -> None:
        self._end()
        if mark:
            self._marks.append((self._indents[-1], mark))
        self._indents.append(self._indents[-1] + by)

    def dedent(self) -> None:
        self._end()
        self._indents.pop()
        while self._marks and self._marks[-1][0] >= self._indents[-1]:
            self._marks.pop()

    def finish(self) -> list[str]:
        self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


# ---------------------------------------------------------------- rendering: each step returns the steps to take next, in order


def _number(text: str | None, default: int, least: int, most: int) -> int:
    return min(max(int(text), least), most) if text and re.fullmatch(r"\s*[-+]?\d{1,9}\s*", text) else default


def label(number: int, kind: str) -> str:
    """A list item's number, in letters or Roman numerals where ``type`` says so."""
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, k = divmod(number - 1, 26)
            out = chr(97 + k) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (number // value)
            number %= value
        return out.upper() if kind == "I" else out
    return str(number)


def _children(page: Page, node: Node, pre: bool, seen: bool, tables: int) -> list:
    return [(_render, page, c, pre, seen, tables) for c in node.children]


def _list(page: Page, node: Node, seen: bool, tables: int) -> list:
    margin = 0 if page.nested else 1
    items = [c for c in node.children if isinstance(c, Node) and c.name == "li"]
    back = node.name == "ol" and "reversed" in node.attrs
    number = _number(node.attrs.get("start"), len(items) if back else 1, -(10**9), 10**9)
    steps = [(page.block, margin)]
    for c in node.children:
        if isinstance(c, Node) and c.name == "li":
            shown, own = look(c, seen)
            number = _number(c.attrs.get("value"), number, -(10**9), 10**9)
            mark = f"{label(number, c.attrs.get('type', node.attrs.get('type', '')))}. " if node.name == "ol" else "- "
            if shown:
                number += -1 if back else 1
                steps += [(page.indent, len(mark), mark if own else ""), *_children(page, c, False, own, tables), (page.dedent,)]
        else:
            steps.append((_render, page, c, False, seen, tables))
    return [*steps, (page.block, margin)]


def _table(page: Page, node: Node, seen: bool, tables: int) -> list:
    """Captions and loose content, then each row's cells on pages of their own, then the grid."""
    loose, sections, bare = [(page.block, 1)], [], False
    for c in node.children:
        if isinstance(c, Node) and c.name in SECTIONS:
            shown, own = look(c, seen)
            if shown:
                sections.append((c.name, [(x, own) for x in c.children if isinstance(x, Node) and x.name == "tr"]))
                loose += [(_render, page, x, False, own, tables) for x in c.children if not (isinstance(x, Node) and x.name == "tr")]
            bare = False
        elif isinstance(c, Node) and c.name == "tr":
            if not bare:  # rows without a section have one in common
                sections.append(("tbody", []))
                bare = True
            sections[-1][1].append((c, seen))
        elif isinstance(c, str) or c.name not in ("colgroup", "col"):
            loose.append((_render, page, c, False, seen, tables))
    heads = [k for k, (name, _) in enumerate(sections) if name == "thead"][:1]
    feet = [k for k, (name, _) in enumerate(sections) if name == "tfoot"][:1]
    order = heads + [k for k in range(len(sections)) if k not in heads + feet] + feet
    steps, grid = [], []
    for k in order:
        grid.append([])
        for row, above in sections[k][1]:
            shown, of_row = look(row, above)
            if not shown:
                continue
            cells = []
            for c in row.children:
                if isinstance(c, Node) and c.name in ("td", "th"):
                    shown, of_cell = look(c, of_row)
                    if not shown:
                        continue
                    inner = c.children
                    spans = _number(c.attrs.get("colspan"), 1, 1, 1000), _number(c.attrs.get("rowspan"), 1, 0, 65534)
                elif isinstance(c, str) and not c.strip(_WS):
                    continue
                else:
                    inner, of_cell, spans = [c], of_row, (1, 1)
                cell = page if tables >= TABLES else Page()
                steps += [(_render, cell, x, False, of_cell, tables + 1) for x in inner]
                if cell is page:
                    steps.append((page.block, 0))
                else:
                    cells.append((cell, *spans))
            grid[-1].append(cells)
    return [*loose, (page.block, 0), *steps, (_grid, page, grid), (page.block, 1)]


def _grid(page: Page, sections: list) -> None:
    """Places cells in columns, past those that rows above reach down into, and writes the rows."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    for rows in sections:
        down: dict[int, int] = {}  # column -> rows that a cell above still takes
        for r, cells in enumerate(rows):
            k, line = 0, []
            for cell, across, deep in cells:
                while down.get(k):
                    k += 1
                line.append((k, across, cell.finish()))
                for i in range(k, k + across):
                    down[i] = (deep or len(rows) - r) if across == 1 or i == k or not down.get(i) else down[i]
                k += across
            placed.append(line)
            down = {i: left - 1 for i, left in down.items() if left > 1}
    placed = [line for line in placed if any(lines for *_, lines in line)]
    columns = 1 + max((k for line in placed for k, *_ in line), default=-1)
    widths = [0] * columns
    for line in placed:
        for k, across, lines in line:
            if min(across, columns - k) == 1:
                widths[k] = max(widths[k], max(map(width, lines), default=0))
    aligned = sum(widths) + 3 * (columns - 1) <= ALIGNED
    for line in placed:
        for y in range(max(len(lines) for *_, lines in line)):
            if not aligned:
                page.whole([" | ".join(lines[y] for *_, lines in line if y < len(lines) and lines[y])])
                continue
            out, at = [], 0
            for k, across, lines in line:
                out += [" " * w for w in widths[at:k]]
                text, upto = lines[y] if y < len(lines) else "", min(k + across, columns)
                room = sum(widths[k:upto]) + 3 * (upto - k - 1)
                out.append(text + " " * max(0, room - width(text)))
                at = upto
            page.whole([" | ".join(out).rstrip(" ")])


def _render(page: Page, node, pre: bool, seen: bool, tables: int) -> list | None:
    if isinstance(node, str):
        if seen:
            page.preformatted(node) if pre else page.text(node)
        return None
    shown, seen = look(node, seen)
    if not shown:
        return None
    name = node.name
    if name == "br":
        page.line_break()
    elif name == "hr":
        page.block(1)
    elif name in ("img", "input"):
        kind = node.attrs.get("type", "").lower()
        if seen:
            page.text(node.attrs.get("alt", "") if name == "img" or kind == "image" else node.attrs.get("value", "") if kind in FIELDS else "")
    elif name == "table":
        return _table(page, node, seen, tables)
    elif name in ("ul", "ol", "menu", "dir"):
        return _list(page, node, seen, tables)
    elif name in ("blockquote", "dd"):
        margin = 1 if name == "blockquote" else 0
        return [(page.block, margin), (page.indent, 2), *_children(page, node, pre, seen, tables), (page.dedent,), (page.block, margin)]
    elif name in ("pre", "textarea", "xmp", "listing", "plaintext"):
        inner = list(node.children)
        if inner and isinstance(inner[0], str):  # a line feed right after the start tag doesn't count
            inner[0] = inner[0].removeprefix("\n")
        return [(page.block, 1), *[(_render, page, c, True, seen, tables) for c in inner], (page.block, 1)]
    elif name == "details" and "open" not in node.attrs:
        summary = [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
        return [(page.block, 1), *[(_render, page, c, pre, seen, tables) for c in summary], (page.block, 1)]
    elif name in ("td", "th"):
        return [(page.text, " "), *_children(page, node, pre, seen, tables), (page.text, " ")]
    else:
        steps = _children(page, node, pre, seen, tables)
        margin = 1 if name in SPACED else 0 if name in LINED else -1
        return steps if margin < 0 else [(page.block, margin), *steps, (page.block, margin)]
    return None


def text_of(page: str) -> str:
    """All visible text of a page."""
    out = Page()
    todo: list = [(_render, out, parse(page), False, True, 0)]
    while todo:
        step, *args = todo.pop()
        if more := step(*args):
            todo += reversed(more)
    return "\n".join(out.finish())


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns plus ``text`` of ``pages.html``."""
    keep = tuple(c for c in keep if c != "text")
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("html").cast("string").alias("html"))
    types = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            out = pdf[[f"k{i}" for i in range(len(keep))]].copy()
            out["text"] = [None if h is None else text_of(h) for h in pdf["html"]]
            yield out

    found = rows.mapInPandas(run, ", ".join([f"k{i} {types[f'k{i}']}" for i in range(len(keep))] + ["text string"]))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
