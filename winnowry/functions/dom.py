"""A forgiving HTML tree builder: implied and unclosed tags, stray ends, raw text, end of input anywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEAD = frozenset("title meta link base script style template noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag ends an open element of these kinds, searched up to the nearest scope
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "caption": (("caption",), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
FENCES = frozenset("table td th caption button object template html".split())
DEEPEST = 300
TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>\0]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[\"'])*?)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("_attrs", "children", "parent", "raw", "tag")

    def __init__(self, tag: str, raw: str = "", parent: Node | None = None):
        self.tag, self.raw, self.parent, self.children, self._attrs = tag, raw, parent, [], None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            found: dict[str, str] = {}
            if self.raw:
                for name, a, b, c in ATTR.findall(self.raw):
                    value = a or b or c
                    found.setdefault(name.lower(), unescape(value) if "&" in value else value)
            self._attrs = found
        return self._attrs

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def has_class(self, name: str) -> bool:
        return name in self.get("class").split()

    def iter(self, *tags: str) -> Iterator[Node]:
        """Self and all elements below, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            if not tags or node.tag in tags:
                yield node
            for c in reversed(node.children):
                if type(c) is not str:
                    stack.append(c)

    def find(self, test) -> list[Node]:
        return [n for n in self.iter() if n is not self and test(n)]

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(self.strings())

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def append(self, child) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def drop(self) -> None:
        """Leaves the tree; what follows it stays."""
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None

    def replace(self, *new) -> None:
        i = self.index()
        parent = self.parent
        parent.children[i : i + 1] = new
        for n in new:
            if isinstance(n, Node):
                n.parent = parent
        self.parent = None

    def unwrap(self) -> None:
        self.replace(*self.children)

    def copy(self, parent: Node | None = None) -> Node:
        new = Node(self.tag, self.raw, parent)
        new._attrs = None if self._attrs is None else dict(self._attrs)
        new.children = [c if isinstance(c, str) else c.copy(new) for c in self.children]
        return new


def parse(html: str) -> Node:
    """The page's html element; it always has a body, and a head if the page has what belongs there."""
    root = Node("html")
    body: Node | None = None
    head: Node | None = None
    cur, depth, at, end = root, 0, 0, len(html)
    search = TOKEN.search

    def enter_body() -> Node:
        nonlocal body
        if body is None:
            body = Node("body")
            root.append(body)
        return body

    def put_text(text: str) -> None:
        nonlocal cur, depth
        if cur is root or cur is head:
            if not text.strip():
                return
            cur, depth = enter_body(), 2
        if "&" in text:
            text = unescape(text)
        cur.children.append(text)

    while at < end:
        m = search(html, at)
        if m is None:
            put_text(html[at:])
            break
        if m.start() > at:
            put_text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        raw = m["attrs"]
        if m["close"]:
            if tag == "br":
                tag, raw = "br", ""
            elif tag == "p" and not any(n.tag == "p" for n in _open(cur)):
                if cur is root or cur is head:
                    cur, depth = enter_body(), 2
                cur.append(Node("p"))
                continue
            elif tag in ("html", "body"):
                continue
            else:
                node, up = cur, 0
                while node is not None and node.tag != tag and not (tag in HEADINGS and node.tag in HEADINGS):
                    if node.tag in FENCES and tag not in FENCES and tag not in ("tr", "tbody", "thead", "tfoot"):
                        node = None
                        break
                    node, up = node.parent, up + 1
                if node is not None and node.parent is not None and node is not body:
                    cur, depth = node.parent, depth - up - 1
                continue
        if tag == "html":
            root.raw = root.raw or raw
            continue
        if tag == "head":
            if head is None and body is None:
                head = Node("head", raw)
                root.append(head)
                cur, depth = head, 2
            continue
        if tag == "body":
            if body is None:
                enter_body().raw = raw
            if cur is root or cur is head or (head is not None and cur.parent is head):
                cur, depth = body, 2
            continue
        if cur is root:
            if tag in HEAD and body is None:
                if head is None:
                    head = Node("head")
                    root.append(head)
                cur, depth = head, 2
            else:
                cur, depth = enter_body(), 2
        if cur is head and tag not in HEAD:
            cur, depth = enter_body(), 2
        # implied ends
        if tag in BLOCK:
            node, up = cur, 0
            while node is not None and node.tag != "p":
                if node.tag in FENCES or node.tag == "li" or node.tag in BLOCK:
                    node = None
                    break
                node, up = node.parent, up + 1
            if node is not None:
                cur, depth = node.parent, depth - up - 1
            if tag in HEADINGS and cur.tag in HEADINGS:
                cur, depth = cur.parent, depth - 1
        rule = ENDS.get(tag)
        if rule is not None:
            kinds, scopes = rule
            node, up, hit = cur, 0, None
            while node is not None and node.tag not in scopes:
                if node.tag in kinds:
                    hit = (node.parent, up + 1)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                node, up = node.parent, up + 1
            if hit is not None:
                cur, depth = hit[0], depth - hit[1]
        node = Node(tag, raw if raw and raw != "/" else "")
        cur.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            text = html[at : close.start()] if close else html[at:]
            at = close.end() if close else end
            if text:
                node.children.append(unescape(text) if tag in ("textarea", "title") and "&" in text else text)
            continue
        if raw.endswith("/") and tag in ("svg", "path", "math"):
            continue
        if depth < DEEPEST:  # deeper elements are put in the tree, but not entered
            cur, depth = node, depth + 1
    enter_body()
    return root


def _open(node: Node | None) -> Iterator[Node]:
    while node is not None and node.tag not in FENCES:
        yield node
        node = node.parent


def body_of(root: Node) -> Node:
    return next(c for c in root.children if isinstance(c, Node) and c.tag == "body")
