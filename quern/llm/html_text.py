"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules and a text layout."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import held_id, pieces, real_id, small_batches, table

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")

_set = lambda s: frozenset(s.split())
VOID = _set("area base basefont bgsound br col embed frame hr img input link meta param source track wbr")
RAW = _set("script style iframe noembed noframes noscript template title textarea xmp plaintext")
UNSEEN = _set("head title script style template noscript iframe noembed noframes datalist audio video canvas object")
#: Parts of drawings and formulas that are not shown; the text of all others is.
UNSEEN |= _set("desc defs metadata symbol clippath mask pattern marker filter lineargradient radialgradient annotation annotation-xml")
HEAD = _set("base basefont bgsound link meta noframes script style template title")
#: Blocks with an empty line around them, and blocks without.
SPACED = _set("p blockquote ul ol dl h1 h2 h3 h4 h5 h6 pre table figure hr fieldset article section")
PLAIN = _set("html body div header footer nav aside main address form li dt dd tr caption figcaption details summary legend center menu dir hgroup search option optgroup thead tbody tfoot colgroup td th")
BLOCK = SPACED | PLAIN
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
CLOSES_P = (SPACED | _set("div header footer nav aside main address form li dt dd details summary figcaption center menu dir hgroup search")) - _set("option optgroup")
#: A start tag ends these open elements, unless one of the second set is met first.
ENDS = {
    "li": (_set("li"), _set("ul ol menu dir table td th html")), "dt": (_set("dt dd"), _set("dl table td th html")), "dd": (_set("dt dd"), _set("dl table td th html")),
    "option": (_set("option"), _set("select datalist html")), "optgroup": (_set("option optgroup"), _set("select html")),
    "tr": (_set("tr td th caption colgroup"), _set("table html")), "td": (_set("td th"), _set("tr table html")), "th": (_set("td th"), _set("tr table html")),
    "tbody": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table html")),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["colgroup"] = ENDS["caption"] = ENDS["tbody"]
CELL_SCOPE, TABLE_SCOPE, ROWS, P = _set("td th table caption html"), _set("table html"), _set("tr tbody thead tfoot"), _set("p")
#: Cell lines of at most so many characters set the width of their column; a span counts as so many columns at most.
WIDEST, MOST_SPAN = 60, 1000
#: Levels of lists and quotations that indent, and of tables in tables that are laid out in columns.
MOST_INDENTS, MOST_TABLES = 32, 16


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class _Open:
    """The open elements, outermost first, with the places of each tag and of the blocks: the nearest one is at hand."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [], {}, []
        self.push(root)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def nearest(self, tags: frozenset) -> int:
        """The place of the innermost open element of these tags (0: none, or the root)."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def outermost(self, tags: frozenset, within: int) -> int | None:
        """The place of the outermost element of these tags inside the element at a place."""
        found = [at[i] for t in tags if (at := self.places.get(t)) and (i := bisect_right(at, within)) < len(at)]
        return min(found, default=None)


def build(source: str) -> Node:
    """The tree of a page. html, head, body, tr are implied; p, li, dt, dd, option, table parts and headings end by themselves."""
    root = Node("html")
    opened, head, body = _Open(root), None, None
    stack = opened.stack
    at, end = 0, len(source)

    def push(tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        opened.push(node)
        return node

    def into_body() -> None:
        nonlocal body
        if body is None:
            opened.cut(1)
            body = push("body")

    def close(tags: frozenset, barrier: frozenset) -> None:
        """Ends the outermost of these elements that is open within the barrier, and all inside it."""
        found = opened.outermost(tags, opened.nearest(barrier))
        if found is not None:
            opened.cut(found)

    def text(raw: str) -> None:
        if not raw:
            return
        if body is None:
            if stack[-1].tag == "head" or len(stack) == 1:
                if not raw.strip(" \t\n\r\f"):
                    return
                into_body()
        value = html.unescape(raw) if "&" in raw else raw
        stack[-1].kids.append(value)

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                into_body()
                stack[-1].kids.append(Node("br"))
            elif tag in ("html", "body"):
                pass
            elif tag == "head":
                if stack[-1].tag == "head":
                    opened.cut(len(stack) - 1)
            elif tag in BLOCK:
                own = opened.nearest(HEADINGS if tag in HEADINGS else frozenset((tag,)))
                scope = opened.nearest(TABLE_SCOPE if tag in CELL_SCOPE or tag in ROWS else CELL_SCOPE)
                if own and own >= scope:
                    opened.cut(own)
                elif tag == "p" and not scope:
                    into_body()
                    stack[-1].kids.append(Node("p"))
            elif (own := opened.nearest(frozenset((tag,)))) > opened.blocks[-1]:
                opened.cut(own)
            continue
        raw = m[3] or m[6] or ""
        attrs = _attributes(raw) if raw.strip(" /\n\t\r\f") else {}
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag == "head":
            if head is None and body is None:
                head = push("head", attrs)
            continue
        if tag == "body":
            into_body()
            body.attrs = attrs | body.attrs
            continue
        if body is None:
            if tag in HEAD:
                if head is None:
                    head = push("head")
            else:
                into_body()
        if tag in CLOSES_P:
            close(P, CELL_SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            opened.cut(len(stack) - 1)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr")
        if tag in VOID:
            stack[-1].kids.append(Node(tag, attrs))
        elif tag in RAW:
            node = Node(tag, attrs)
            stack[-1].kids.append(node)
            if tag == "plaintext":
                node.kids.append(source[at:])
                break
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            inner = source[at : stop.start() if stop else end]
            node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = stop.end() if stop else end
        else:
            push(tag, attrs)
    return root


def hidden(node: Node) -> bool:
    """Whether a node and all within are not shown."""
    if node.tag in UNSEEN:
        return True
    a = node.attrs
    if not a:
        return node.tag == "dialog"
    return "hidden" in a or bool(_HIDDEN_STYLE.search(a.get("style", ""))) or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden")


class _Flow:
    """Lines of one block context (the page or a table cell)."""

    __slots__ = ("lines", "run", "gap", "indents", "mark", "pre")

    def __init__(self):
        self.lines, self.run, self.gap, self.indents, self.mark, self.pre = [], [], 0, [], None, 0

    def end_line(self, forced: bool = False) -> None:
        if self.pre:
            whole = "".join(self.run)
            lines = whole.split("\n")
            if not whole.strip("\n") and not forced:
                lines = []
        else:
            line = _BLANKS.sub(" ", "".join(self.run)).strip(" ")
            lines = [line] if line or (forced and self.lines and self.lines[-1]) else []
        self.run = []
        for line in lines:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            indent = "".join(self.indents[:MOST_INDENTS])
            if self.mark is not None and line:
                indent = indent[: len(indent) - len(self.mark)] + self.mark
                self.mark = None
            self.lines.append((indent + line).rstrip(" ") if not self.pre else indent + line)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(spaced))


def _number(value: str | None, other: int) -> int:
    try:
        return int((value or "").strip())
    except ValueError:
        return other


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned lines of a table: rows of (lines, columns, rows) cells; cells that span rows keep their columns free below."""
    width: dict[int, int] = {}
    placed, busy = [], {}
    for row in rows:
        column, out = 0, []
        for lines, across, down in row:
            while busy.get(column, 0) > 0:
                column += 1
            out.append((column, across, lines))
            if across == 1:
                width[column] = max([width.get(column, 0), *(len(x) for x in lines if len(x) <= WIDEST)])
            if down > 1:
                for c in range(column, column + across):
                    busy[c] = max(busy.get(c, 0), down)
            column += across
        busy = {c: n - 1 for c, n in busy.items() if n > 1}
        placed.append(out)
    text = []
    for row in placed:
        for i in range(max((len(x[2]) for x in row), default=0)):
            line, at = "", 0
            for column, _, lines in row:
                while at < column:
                    line += " " * width[at] + "  " if at in width else ""
                    at += 1
                start = len(line)
                if i < len(lines):
                    line += lines[i]
                nxt = start + width.get(column, 0)
                line = line.ljust(nxt) + "  "
                at = column + 1
            text.append(line.rstrip(" "))
    return text


def render(root: Node) -> str:
    """All visible text: an empty line around spaced blocks, list marks with indents, table cells in columns, pre as it is."""
    flows = [_Flow()]
    lists: list[list] = []
    tables: list[list] = []
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.run.append(node)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node):
                continue
            if tag == "br":
                if flow.pre:
                    flow.run.append("\n")
                else:
                    flow.end_line(True)
                continue
            if tag == "hr":
                flow.block(True)
                continue
            if tag in VOID:
                continue
            if tag in ("td", "th") and tables and tables[-1] is None:
                flow.block(False)
            elif tag in ("td", "th"):
                flows.append(_Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.block(not lists and tag in ("ul", "ol"))
                lists.append([tag, _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                flow.block(False)
                kind = lists[-1] if lists else ["ul", 1]
                if kind[0] == "ol":
                    kind[1] = _number(node.attrs.get("value"), kind[1])
                    mark = f"{kind[1]}. "
                    kind[1] += 1
                else:
                    mark = "- "
                flow.indents.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.block(tag == "blockquote")
                flow.indents.append("  ")
            elif tag == "table":
                flow.block(True)
                tables.append([] if len(tables) < MOST_TABLES else None)
            elif tag == "tr":
                if tables and tables[-1] is not None:
                    tables[-1].append([])
                else:
                    flow.block(False)
            elif tag in BLOCK:
                flow.block(tag in SPACED)
                if tag == "pre":
                    flow.pre += 1
                    if node.kids and isinstance(node.kids[0], str) and node.kids[0][:1] == "\n":
                        node.kids[0] = node.kids[0][1:]
            todo.append((node, True))
            todo.extend((k, False) for k in reversed(node.kids))
            continue
        if tag in ("td", "th") and tables and tables[-1] is None:
            flow.block(False)
        elif tag in ("td", "th"):
            flow.end_line()
            flows.pop()
            a = node.attrs
            span = lambda k: min(max(_number(a.get(k), 1), 1), MOST_SPAN)  # noqa: B023, E731
            if tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((flow.lines, span("colspan"), span("rowspan")))
            else:
                for line in flow.lines:
                    flows[-1].run.append(line)
                    flows[-1].end_line()
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.block(not lists and tag in ("ul", "ol"))
        elif tag == "li":
            flow.end_line()
            flow.indents.pop()
            flow.mark = None
            flow.block(False)
        elif tag in ("dd", "blockquote"):
            flow.end_line()
            flow.indents.pop()
            flow.block(tag == "blockquote")
        elif tag == "table":
            flow.end_line()
            for line in _grid(tables.pop() or []):
                flow.run, flow.pre = [line], flow.pre + 1
                flow.end_line(True)
                flow.pre -= 1
            flow.block(True)
        elif tag == "pre":
            flow.end_line()
            flow.pre -= 1
            flow.block(True)
        elif tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            flow.block(tag in SPACED)
    flows[0].end_line()
    return "\n".join(flows[0].lines).strip("\n")


def page_text(source: str | None) -> str | None:
    return None if source is None else render(build(source))


def _extract(batches):
    for x in batches:
        pages = x["html"].tolist()
        for a, b in pieces(pages, 2 << 20):
            texts = [page_text(p) for p in pages[a:b]]
            yield pd.DataFrame({"page_id": x["page_id"].iloc[a:b].to_numpy(), "text": texts, "n_chars": [0 if t is None else len(t) for t in texts]})


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars: the visible text of each page.

    Text of drawings and formulas is shown in line, but not their titles, descriptions, definitions and
    annotations. A cell line of over 60 characters does not widen its column, so what stands right of it is not
    aligned with the rows above and below. Lists and quotations indent up to 32 levels; tables within 16 tables or
    more are not laid out, each of their cells is a block.

    A null page has null text and 0 characters, an empty one empty text; broken markup is read as far as it
    goes; null ids and repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    small_batches(pages.sparkSession)
    slim = pages.select(held_id(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return slim.mapInPandas(_extract, "page_id long, text string, n_chars long").withColumn("page_id", real_id("page_id"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages", "page_id", "html"))
