"""Layout-aware rendering of HTML pages as text."""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .words import cut_batches
from winnowry.functions.dom import Node, body_of, parse

UNSEEN = frozenset("head script style template noscript iframe object embed audio video canvas map datalist param source track link meta base title noembed noframes area".split())
#: Inside svg and math only.
UNDRAWN = frozenset("defs desc metadata symbol clippath annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol menu dir dl pre xmp table figure fieldset hr".split())
LINES = frozenset("address article aside body center details dialog div dt dd figcaption footer form header hgroup legend li main nav option optgroup section summary caption tr thead tbody tfoot".split())
HIDDEN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
SEEN = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
WHITE = re.compile(r"[ \t\n\r\f]+")
RESULT = "page_id bigint, text string, n_lines bigint, n_chars bigint, text_sha256 string"


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN or (node.tag in UNDRAWN and any(a.tag in ("svg", "math") for a in node.ancestors())):
        return True
    raw = node.raw
    if not raw:
        return False
    if "hidden" in raw or "style" in raw or "HIDDEN" in raw or "STYLE" in raw or "Hidden" in raw or "Style" in raw:
        a = node.attrs
        return ("hidden" in a and a["hidden"].lower() != "until-found") or (node.tag == "input" and a.get("type", "").lower() == "hidden") or bool(HIDDEN.search(a.get("style", "")))
    return False


def veil(body: Node) -> None:
    """Takes out the text that visibility hides; a descendant that is set visible stays."""
    todo = [(body, True)]
    while todo:
        node, shown = todo.pop()
        if node.raw and "visibility" in node.raw.lower():
            found = SEEN.findall(node.attrs.get("style", ""))
            shown = found[-1].lower() == "visible" if found else shown
        if not shown:
            # what it draws itself goes as well: rules, fields, quotation marks, list marks
            node.tag = {"q": "span", "li": "div"}.get(node.tag, node.tag)
            node.children = [c for c in node.children if isinstance(c, Node) and (c.tag not in ("hr", "input") or "visibility" in c.raw.lower())]
            if node.tag in ("hr", "input"):
                node.tag = "span"
        todo += [(c, shown) for c in node.children if isinstance(c, Node)]


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Canvas:
    """Lines under way: pending white space and blank lines come out only before the next visible text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False

    def write(self, text: str) -> None:
        """Text whose white space runs count as one blank."""
        if WHITE.sub("", text[:1]) == "" and text:
            self.space = True
        words = [w for w in WHITE.split(text) if w]
        if not words:
            return
        if not self.line and self.gap and self.lines:
            self.lines.append("")
        if not self.line:
            self.gap = False
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = text[-1] in " \t\n\r\f"

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False

    def block(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.extend(lines)

    def blank(self) -> None:
        self.end_line()
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def flow(node: Node, out: Canvas) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.write(child)
            continue
        tag = child.tag
        if hidden(child):
            continue
        if tag == "br":
            if out.line:
                out.end_line()
            elif out.lines and not out.gap:
                out.gap = True
        elif tag == "hr":
            out.blank()
            out.block(["---"])
            out.blank()
        elif tag in ("pre", "xmp", "textarea"):
            out.blank()
            lines = "".join(visible(child)).replace("\r\n", "\n").split("\n")
            while lines and not lines[0].strip():
                lines.pop(0)
            while lines and not lines[-1].strip():
                lines.pop()
            out.block([x.rstrip() for x in lines])
            out.blank()
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = any(a.tag in ("ul", "ol", "menu", "dir") for a in child.ancestors())
            out.end_line() if nested else out.blank()
            out.block(listing(child))
            out.end_line() if nested else out.blank()
        elif tag == "table":
            out.blank()
            out.block(table(child))
            out.blank()
        elif tag == "blockquote":
            inner = Canvas()
            flow(child, inner)
            out.blank()
            out.block(["> " + x if x else ">" for x in inner.done()])
            out.blank()
        elif tag == "dd":
            inner = Canvas()
            flow(child, inner)
            out.block(["    " + x if x else "" for x in inner.done()])
        elif tag == "input":
            if child.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                out.write(child.get("value"))
        elif tag == "q":
            out.write("“")
            flow(child, out)
            out.write("”")
        elif tag in SPACED:
            out.blank()
            flow(child, out)
            out.blank()
        elif tag in LINES:
            out.end_line()
            flow(child, out)
            out.end_line()
        elif tag in ("td", "th", "text"):  # outside a table; text of an svg
            out.write(" ")
            flow(child, out)
            out.write(" ")
        else:
            flow(child, out)


def visible(node: Node) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag == "br":
            yield "\n"
        elif not hidden(child):
            yield from visible(child)


def listing(node: Node) -> list[str]:
    """Items with marks, what belongs to an item under its first word."""
    items = [c for c in node.children if isinstance(c, Node) and not hidden(c)]
    number = node.get("start").strip()
    number = int(number) if re.fullmatch(r"-?[0-9]{1,9}", number) else 1
    step = 1
    if node.tag == "ol" and "reversed" in node.attrs:
        step, number = -1, number if node.get("start") else sum(c.tag == "li" for c in items)
    lines: list[str] = []
    loose: Node | None = None
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            if isinstance(child, str) and not child.strip():
                continue
            loose = loose or Node("div")
            loose.children.append(child)
            continue
        if loose:
            lines += inner_lines(loose)
            loose = None
        if hidden(child):
            continue
        value = child.get("value").strip()
        if re.fullmatch(r"-?[0-9]{1,9}", value):
            number = int(value)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += step
        inner = inner_lines(child)
        if inner:
            pad = " " * len(mark)
            lines += [mark + inner[0], *(pad + x if x else "" for x in inner[1:])]
    return lines + (inner_lines(loose) if loose else [])


def inner_lines(node: Node) -> list[str]:
    out = Canvas()
    flow(node, out)
    return out.done()


def span(node: Node, name: str, most: int) -> int:
    value = node.get(name).strip() if node.raw else ""
    return min(max(int(value), 1), most) if re.fullmatch(r"[0-9]{1,4}", value) else 1


def table(node: Node) -> list[str]:
    """The caption, then rows with cells padded to their columns' widths; cells may hold several lines."""
    captions, rows, head, foot, other = [], [], [], [], []

    def collect(part: Node, into: list[Node]) -> None:
        for c in part.children:
            if isinstance(c, str):
                if c.strip():
                    other.append(c)
            elif hidden(c):
                continue
            elif c.tag == "caption":
                captions.append(c)
            elif c.tag == "tr":
                into.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                collect(c, {"thead": head, "tfoot": foot}.get(c.tag, rows))
            elif c.tag in ("td", "th"):
                row = Node("tr")
                row.children = [c]
                into.append(row)
            elif c.tag not in ("colgroup", "col"):
                other.append(c)

    collect(node, rows)
    lines = [x for c in captions for x in inner_lines(c)]
    if other:
        rest = Node("div")
        rest.children = other
        lines += inner_lines(rest)
    grid: list[dict[int, tuple[list[str], int]]] = []
    below: dict[int, int] = {}
    for row in [*head, *rows, *foot]:
        cells: dict[int, tuple[list[str], int]] = {}
        column = 0
        for c in row.children:
            if isinstance(c, str):
                if not c.strip():
                    continue
                text, wide, high = [" ".join(c.split())], 1, 1
            elif hidden(c):
                continue
            else:
                text = inner_lines(c) if c.tag in ("td", "th") else inner_lines(_only(c))
                wide, high = span(c, "colspan", 1000), span(c, "rowspan", 1000)
            while below.get(column, 0):
                column += 1
            cells[column] = (text, wide)
            for k in range(column, column + wide):
                if high > 1:
                    below[k] = high
            column += wide
        below = {k: v - 1 for k, v in below.items() if v > 1}
        grid.append(cells)
    used = sorted({k for cells in grid for k, (text, _) in cells.items() if text})
    if not used:
        return lines
    if len(used) == 1:
        return lines + [x for cells in grid for k in cells for x in cells[k][0]]
    order = {k: i for i, k in enumerate(used)}
    size = [0] * len(used)
    for cells in grid:
        for k, (text, wide) in cells.items():
            if wide == 1 and k in order:
                size[order[k]] = max(size[order[k]], max(map(width, text), default=0))
    for cells in grid:
        high = max((len(t) for t, _ in cells.values()), default=0)
        for y in range(high):
            line, at = "", 0
            for k in sorted(cells):
                text, _ = cells[k]
                if k not in order:
                    continue
                goal = sum(size[: order[k]]) + 3 * order[k]
                if at and at < goal:
                    line += " " * (goal - at - 2) + "| " if goal - at >= 2 else " " * (goal - at)
                elif at:
                    line += " | "
                elif goal:
                    line += " " * goal
                line += text[y] if y < len(text) else ""
                at = width(line)
            lines.append(line.rstrip())
    return lines


def _only(node: Node) -> Node:
    holder = Node("div")
    holder.children = [node]
    return holder


def render(html: str | None) -> str:
    """All visible text of a page: blocks apart, lists marked, table columns aligned. Null or empty: empty."""
    if not html:
        return ""
    body = body_of(parse(html))
    if hidden(body):
        return ""
    if "visibility" in html.lower():
        veil(body)
    out = Canvas()
    flow(body, out)
    return "\n".join(x.rstrip() for x in out.done()).strip("\n")


@released
def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import sys

    sys.setrecursionlimit(20_000)
    for batch in cut_batches(stream, "html"):
        text = [render(h) for h in batch.column("html").to_pylist()]
        n = [t.count("\n") + 1 if t else 0 for t in text]
        sha = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in text]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(text), pa.array(n, pa.int64()), pa.array(list(map(len, text)), pa.int64()), pa.array(sha)], ["page_id", "text", "n_lines", "n_chars", "text_sha256"])
        gc.collect()  # trees hold cycles


def extract(pages: DataFrame) -> DataFrame:
    """Every page's visible text. Null and empty pages give empty text; repeated rows are rendered each; other columns are dropped."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(batches, RESULT)
