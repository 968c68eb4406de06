"""Layout-aware text of web pages: a tree with implied tags, rendered with block spacing, lists and
aligned table cells."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Never visible.
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Blocks set apart by an empty line, and blocks that start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
LINES = frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form "
    "header hgroup html legend li main menu nav option section summary tr tbody thead tfoot".split()
)
BLOCKS = SPACED | LINES
#: An opening tag closes open elements of these names, looked for up to a barrier.
_ROWS, _CELLS = frozenset(("tr", "td", "th")), frozenset(("td", "th"))
_PARTS = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (_ROWS | {"caption"}, frozenset(("table",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
} | {part: (_ROWS | _PARTS, frozenset(("table",))) for part in _PARTS}
_IN_P = (frozenset(("p",)), frozenset(("table", "td", "th", "caption", "button", "object")))
#: An end tag reaches through none of these, unless it names one.
SCOPE = frozenset(("table", "td", "th", "caption", "html"))
MOST_NESTED_TABLES = 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>=]|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?", re.S)
#: What the attributes of an element that may be hidden hold.
_MAYBE_HIDDEN = re.compile(r"hidden|display|&#", re.I)
#: Parts of a style that hold no declarations.
_INERT = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z)", re.S)
_INTEGER = re.compile(r"\s*([+-]?\d{1,9})(?!\d)", re.A)
MOST_COLSPAN = 1000  # as HTML has it
_SPACE = re.compile(r"[ \t\n\r\f\xa0]+")


def attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name, of equal names the first; a name alone has the empty value."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def declarations(style: str) -> dict[str, str]:
    """Values by property of a style attribute, in lower case."""
    found: dict[str, str] = {}
    urgent = set()
    for part in _INERT.sub(" ", style).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        name, value = name.strip(), value.strip()
        if value and (mark or name not in urgent):
            found[name] = value
            if mark:
                urgent.add(name)
    return found


class Node:
    __slots__ = ("name", "attrs", "children", "_values")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children, self._values = name, attrs, [], None

    def values(self) -> dict[str, str]:
        if self._values is None:
            self._values = attributes(self.attrs)
        return self._values

    def number(self, attr: str, default: int) -> int:
        found = _INTEGER.match(self.values().get(attr, "")) if self.attrs else None
        return int(found[1]) if found else default

    def hidden(self) -> bool:
        if not self.attrs or not _MAYBE_HIDDEN.search(self.attrs):
            return False
        values = self.values()
        if values.get("hidden", "false").strip().lower() != "false":
            return True
        style = declarations(values.get("style", ""))
        return style.get("display") == "none" or style.get("visibility") == "hidden"


class Builder:
    """Takes tags and text in order; keeps the elements that are open."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.name] -= 1
        del self.open[at:]

    def _close(self, names: frozenset[str], barrier: frozenset[str]) -> None:
        if not any(self.count[n] for n in names):
            return
        found = 0
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].name
            if name in barrier:
                break
            if name in names:
                found = at
        if found:
            self._cut(found)

    def start(self, name: str, attrs: str) -> None:
        if name in ("html", "body"):
            # Once only: the root stands for both, unless the body is hidden.
            if self.count["head"]:
                self._close(frozenset(("head",)), frozenset())
            if name == "html" or self.count[name] or not attrs:
                return
        if self.count["head"] and name not in IN_HEAD:
            self._close(frozenset(("head",)), frozenset())
        if name in BLOCKS:
            self._close(*_IN_P)
        if name in CLOSES:
            self._close(*CLOSES[name])
        if name in _CELLS and self.open[-1].name in ("table", "thead", "tbody", "tfoot"):
            self.start("tr", "")
        node = Node(name, attrs)
        self.open[-1].children.append(node)
        if name not in VOID:
            self.open.append(node)
            self.count[name] += 1

    def end(self, name: str) -> None:
        if name in ("html", "body") or not self.count[name]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            found = self.open[at].name
            if found == name:
                self._cut(at)
                return
            if found in SCOPE and name not in SCOPE | _PARTS | {"tr"}:
                return

    def text(self, text: str) -> None:
        if self.count["head"] and self.open[-1].name == "head" and not text.isspace():
            self._close(frozenset(("head",)), frozenset())
        self.open[-1].children.append(text)


def tree(page: str) -> Node:
    """The elements of a page; never fails, whatever the markup."""
    built, at = Builder(), 0
    match = _TOKEN.search(page, at)
    while match:
        if match.start() > at:
            built.text(html.unescape(page[at : match.start()]))
        at = match.end()
        if match[2]:
            name = match[2].lower()
            if match[1]:
                built.end(name)
            else:
                built.start(name, match[3])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    inside = page[at : close.start() if close else len(page)]
                    built.text(html.unescape(inside) if name == "textarea" else inside)
                    built.end(name)
                    at = close.end() if close else len(page)
        match = _TOKEN.search(page, at)
    if at < len(page):
        built.text(html.unescape(page[at:]))
    return built.root


class Lines:
    """Text laid out in lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.apart = 0  # line ends due before the next text
        self.space = False
        self.indent = ""
        self.marker = ""

    def write(self, text: str, kept: bool = False) -> None:
        if not text:
            return
        if not self.line:
            if self.apart > 1 and self.lines:
                self.lines.append("")
            self.apart = 0
            self.line.append(self.marker or self.indent)
            self.marker = ""
        elif self.space and not kept:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def flow(self, text: str) -> None:
        """Text whose white space counts as one space between words, none at the ends of lines."""
        words = _SPACE.sub(" ", text)
        if words[:1] == " ":
            self.space = True
        if words.strip(" "):
            self.write(words.strip(" "))
            self.space = words[-1] == " "

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, apart: int) -> None:
        self.end()
        self.apart = max(self.apart, apart)

    def br(self) -> None:
        if not self.line:
            self.lines.append("")
        self.end()

    def kept(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.write(first, True)
        for line in rest:
            self.br()
            self.write(line, True)


def _cells(table: Node) -> Iterator[list[Node]]:
    """The cells of each row; nested tables are not looked into."""
    for part in table.children:
        if isinstance(part, Node) and not _unseen(part):
            if part.name == "tr":
                yield [c for c in part.children if isinstance(c, Node) and c.name in _CELLS and not _unseen(c)]
            elif part.name in ("thead", "tbody", "tfoot"):
                yield from _cells(part)


def _strays(table: Node) -> Iterator[Node | str]:
    """What stands in a table outside its cells; browsers show it before the table."""
    for part in table.children:
        if isinstance(part, str):
            if not part.isspace():
                yield part
        elif part.name in ("tr", "thead", "tbody", "tfoot"):
            if not _unseen(part):
                yield from _strays(part)
        elif part.name not in _CELLS and part.name not in ("caption", "colgroup", "col"):
            yield part


def _table(table: Node, out: Lines, nested: int) -> None:
    """Rows of cells, each column as wide as its widest cell that spans no others, lines of a cell
    below each other."""
    rows, spanning = [], set()
    for cells in _cells(table):
        row: list[list[str]] = []
        for cell in cells:
            row.append(render(cell, nested + 1).split("\n"))
            span = min(cell.number("colspan", 1), MOST_COLSPAN)
            if span > 1:
                spanning.add((len(rows), len(row) - 1))
            row += [[""]] * (span - 1)
        if row:
            rows.append(row)
    widths = [0] * max(map(len, rows), default=0)
    for k, row in enumerate(rows):
        for i, cell in enumerate(row):
            if (k, i) not in spanning:
                widths[i] = max(widths[i], *map(len, cell))
    for row in rows:
        for k in range(max(map(len, row))):
            parts = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, widths)]
            while parts and not parts[-1].strip(" "):
                parts.pop()
            out.block(1)
            out.write(" | ".join(parts).rstrip(" ") or " ", True)
    out.block(1)


def _unseen(node: Node) -> bool:
    return node.name in UNSEEN or node.hidden()


def render(root: Node, nested: int = 0) -> str:
    """The visible text below ``root``."""
    out = Lines()
    lists: list[list] = []  # name and number of each open list
    todo: list = [(n, False) for n in reversed(root.children)]
    pre = int(root.name == "pre")
    while todo:
        node, done = todo.pop()
        if isinstance(node, str):
            out.kept(node) if pre else out.flow(node)
            continue
        name = node.name
        if done:
            if name == "pre":
                pre -= 1
            if name in ("ul", "ol", "menu") and lists:
                out.indent = lists.pop()[2]
            if name == "li" or name == "dd" or name == "blockquote":
                out.end()
                out.indent, out.marker = out.indent[:-2], ""
            out.block(2 if name in SPACED and not lists else 1)
            continue
        if _unseen(node):
            continue
        if name == "br":
            out.br()
            continue
        if name in BLOCKS:
            out.block(2 if name in SPACED and not lists else 1)
        if name == "table" and nested < MOST_NESTED_TABLES:
            before = Node("div")
            before.children = list(_strays(node))
            captions = [n for n in node.children if isinstance(n, Node) and n.name == "caption"]
            for part in (before, *captions):
                if part.children and not _unseen(part):
                    out.block(1)
                    out.kept(render(part, nested + 1))
            _table(node, out, nested)
            out.block(2)
            continue
        if name in _CELLS:
            out.space = True
        if name == "pre":
            pre += 1
        if name in ("ul", "ol", "menu"):
            lists.append([name, node.number("start", 1), out.indent])
        if name == "li":
            ordered = lists and lists[-1][0] == "ol"
            out.marker = out.indent + (f"{lists[-1][1]}. " if ordered else "- ")
            if ordered:
                lists[-1][1] += 1
        if name == "li" or name == "dd" or name == "blockquote":
            out.indent += "  "
        if name in BLOCKS:
            todo.append((node, True))
        todo.extend((n, False) for n in reversed(node.children))
    out.end()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return "\n".join(out.lines)


def page_text(page: str | None) -> str:
    """The visible text of a page; the empty text for null."""
    return render(tree(page)) if page else ""


@F.pandas_udf(T.StringType())
def _page_text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)


def extract_text(pages: DataFrame, id_col: str = "page_id", page: str = "html") -> DataFrame:
    """One row for each row of ``pages``: the id and ``text``, all its visible text.

    Null and empty pages have empty text; null and repeated ids keep a row each; an empty table
    gives an empty result; other columns are not looked at.
    """
    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col), _page_text(F.col(page)).alias("text"))
