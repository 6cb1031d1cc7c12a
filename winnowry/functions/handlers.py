"""Page kinds with structure of their own: question pages, forums, blog comments, repositories, embedded data."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from .dom import Node, body_of, parse
from .segment import Paragraph, paragraphs, squeeze


def made(text: str) -> Paragraph:
    return Paragraph("", "/", [text], synthetic=True)


def has(node: Node, name: str) -> bool:
    return name in node.get("class").split()


def first(nodes):
    return next(iter(nodes), None)


def line(node: Node | None) -> str:
    return " ".join(node.text().split()) if node is not None else ""


def below(node: Node, name: str) -> list[Node]:
    return node.find(lambda n: has(n, name))


def tidy_date(text: str) -> str:
    return re.sub(r"(?<=\d)(?:st|nd|rd|th)\b", "", " ".join(text.split())).strip(" ,")


def unquoted(node: Node) -> Node:
    new = node.copy()
    for n in new.find(lambda n: has(n, "quote") or (n.tag == "blockquote" and not has(n, "postcontent"))):
        if n.parent is not None:
            n.drop()
    return new


def container(body: Node, bodies: list[Node]) -> Node:
    """The largest element around a post that holds no other post."""
    others = {id(b) for b in bodies if b is not body}
    node = body
    for up in body.ancestors():
        if any(id(n) in others for n in up.iter()):
            break
        node = up
    return node


def thread(root: Node, posts: list[tuple[str, str, Node]], quotes: bool = False) -> list[Paragraph] | None:
    """A title and each post under its author and date; None if fewer than two posts have text."""
    out, n = [], 0
    for author, date, body in posts:
        text = paragraphs(body if quotes else unquoted(body))
        if text:
            n += 1
            head = f"**{author or 'Anonymous'}**" + (f" ({tidy_date(date)})" if date.strip() else "") + ":"
            out += [made(head), *text]
    if n < 2:
        return None
    title = first(t for h in ("h1", "h2") for t in root.iter(h) if line(t))
    return ([made(line(title))] if title is not None else []) + out


def forum(find: Callable[[Node], list[Node]], author, date, quotes: bool = False):
    def handler(root: Node, html: str) -> list[Paragraph] | None:
        bodies = find(root)
        if len(bodies) < 2:
            return None
        posts = []
        for b in bodies:
            box = container(b, bodies)
            posts.append((author(box), date(box), b))
        return thread(root, posts, quotes)

    return handler


def by_class(*names: str):
    def get(box: Node) -> str:
        for name in names:
            for n in below(box, name):
                if line(n):
                    return line(n)
        return ""

    return get


DATE = re.compile(r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}[^<\n]{0,12}|\d{1,2}[-/. ]\w{2,9}[-/. ]\d{2,4}(?:,? \d{1,2}:\d{2}(?: ?[AP]M)?)?")


def found_date(*names: str):
    named = by_class(*names)

    def get(box: Node) -> str:
        text = named(box)
        if text and DATE.search(text):
            return DATE.search(text)[0]
        m = DATE.search(line(box))
        return text or (m[0] if m else "")

    return get


def question_page(root: Node, html: str) -> list[Paragraph] | None:
    """A question with its answers and comments."""
    question = first(n for n in root.iter("div") if n.get("id") == "question")
    body = question and (first(below(question, "post-text")) or first(below(question, "js-post-body")))
    if not body:
        return None

    def author(post: Node) -> str:
        owner = first(below(post, "owner")) or post
        names = [line(a) for d in below(owner, "user-details") for a in d.iter("a") if line(a)]
        return (names or [""])[-1]

    def comments(post: Node) -> list[Paragraph]:
        seen = dict.fromkeys(f"- {line(c)}" for c in below(post, "comment-copy") if line(c))
        return [made("**Comments**"), *map(made, seen)] if seen else []

    title = first(t for t in root.iter("h1") if line(t))
    out = ([made(line(title))] if title is not None else []) + [made("**Question" + (f" ({author(question)})" if author(question) else "") + "**")]
    out += paragraphs(body) + comments(question)
    answers = [n for n in root.iter("div") if has(n, "answer")]
    for a in answers:
        text = first(below(a, "post-text")) or first(below(a, "js-post-body"))
        if text is None:
            continue
        mark = " (accepted)" if len(answers) > 1 and (has(a, "accepted-answer") or below(a, "vote-accepted-on")) else ""
        out += [made("**Answer" + (f" ({author(a)})" if author(a) else "") + f"**{mark}"), *paragraphs(text), *comments(a)]
    return out


THREADED = re.compile(r"pd\[(\d+)\]\s*=\s*'((?:[^'\\]|\\.)*)'")


def threaded_posts(root: Node, html: str) -> list[Paragraph] | None:
    """Posts that a script writes into the page."""
    found = THREADED.findall(html)
    if len(found) < 3:
        return None
    out = []
    for _, raw in found:
        inner = body_of(parse(re.sub(r"\\(['\"/])", r"\1", raw).replace("\\n", "\n").replace("\\r", "")))
        name = first(by for by in (by_class("bigusername", "username")(inner),) if by)
        post = first(n for n in inner.iter() if n.get("id").startswith("post_message")) or inner
        text = "\n".join(p.text for p in paragraphs(unquoted(post)))
        if text:
            out.append(made((f"{name}: " if name else "") + text))
    return out if len(out) >= 3 else None


def climbing(root: Node, html: str) -> list[Paragraph] | None:
    """Posts known by their ids alone; author and date from one of the ten elements around each."""
    bodies = [n for n in root.iter() if re.fullmatch(r"(?:td_)?post_message_\d+|postmessage_?\d+", n.get("id"))]
    if len(bodies) < 2:
        return None
    posts = []
    for b in bodies:
        author = date = ""
        for k, up in enumerate(b.ancestors()):
            if k >= 10 or (author and date):
                break
            author = author or by_class("bigusername", "username", "author")(up)
            m = DATE.search(line(up))
            date = date or (m[0] if m else "")
        posts.append((author, date, b))
    return thread(root, posts)


def posted_by(root: Node, html: str) -> list[Paragraph] | None:
    items = [n for n in root.iter("li") if n.get("id").startswith("post_") and below(n, "comment-by")]
    posts = []
    for n in items:
        by = below(n, "comment-by")[0]
        m = re.search(r"Posted by\s+(.+?)(?:\s+on\s+(.+))?$", line(by))
        copy = n.copy()
        for x in below(copy, "comment-by"):
            x.drop()
        posts.append((m[1] if m else "", (m[2] or "") if m else "", copy))
    return thread(root, posts) if len(posts) >= 2 else None


def paired(root: Node, html: str) -> list[Paragraph] | None:
    bodies = [n for n in root.iter("td") if has(n, "postbody")]
    names = below(root, "authorName")
    if len(bodies) < 2 or len(bodies) != len(names):
        return None
    posts = []
    for name, b in zip(names, bodies, strict=True):
        m = DATE.search(line(container(b, bodies)))
        posts.append((line(name), m[0] if m else "", b))
    return thread(root, posts)


BYLINE = re.compile(r"posted by\s+(\S+)\s+at\s+([^\[]+?)\s+on\s+([^\[]+?)\s*(?:\[(\d+) favorites?\])?\s*$", re.I)


def comment_stream(root: Node, html: str) -> list[Paragraph] | None:
    """A question followed by comments that end in a byline."""
    out = []
    for c in below(root, "comments"):
        lines = paragraphs(c)
        m = BYLINE.search(line(c))
        if m and lines:
            tail = f" [{m[4]} favorites]" if m[4] else ""
            body = BYLINE.sub("", line(c)).strip()
            out.append((f"**{m[1]}** ({m[2]}, {m[3]}){tail}:", body))
    if len(out) < 2:
        return None
    question = first(below(root, "copy"))
    top = paragraphs(question) + [made("---")] if question is not None else []
    return top + [x for head, body in out for x in (made(head), made(body))]


def embedded_json(html: str, name: str):
    m = re.search(re.escape(name) + r"\s*=\s*", html)
    if not m:
        return None
    rest = html[m.end() :].lstrip()
    try:
        if rest.startswith("JSON.parse("):
            text, _ = json.JSONDecoder().raw_decode(rest[len("JSON.parse(") :].lstrip())
            return json.loads(text)
        return json.JSONDecoder().raw_decode(rest)[0]
    except ValueError:
        return None


def values(data, *names: str):
    stack = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if k in names and isinstance(v, str):
                    yield k, v
                stack.append(v)
        elif isinstance(x, list):
            stack.extend(x)


def collection_item(root: Node, html: str) -> list[Paragraph] | None:
    """An archive's item whose scanned text lies in the page's data."""
    if "collectionAlias" not in html:
        return None
    data = embedded_json(html, "__INITIAL_STATE__")
    if data is None:
        return None
    got: dict[str, str] = {}
    for k, v in values(data, "title", "text", "pageText", "ocr", "about"):
        got[k] = max(got.get(k, ""), re.sub(r"\n{3,}", "\n\n", re.sub("[\ue000-\uf8ff]+", "\n\n", re.sub("<[^>]*>", " ", v))), key=len)
    for keys in (("ocr",), ("title", "text", "pageText"), ("about",)):
        text = "\n\n".join(got[k].strip() for k in keys if got.get(k, "").strip())
        if len(text) >= 400:
            return [made(x) for x in text.split("\n\n") if x.strip()]
    return None


def song_sheet(root: Node, html: str) -> list[Paragraph] | None:
    if "UGAPP.store.page" not in html:
        return None
    data = embedded_json(html, "UGAPP.store.page")
    text = max((v for _, v in values(data, "content")), key=len, default="")
    if len(text) < 200:
        return None
    return paragraphs(body_of(parse("<pre>" + re.sub(r"\[/?(?:ch|tab)\]", "", text) + "</pre>")))


HANDLERS = [
    ("question", question_page),
    ("postbit", forum(lambda r: [n for n in r.iter() if re.fullmatch(r"post_message_\d+", n.get("id"))], by_class("username"), found_date("date"))),
    ("threaded", threaded_posts),
    ("climbing", climbing),
    ("postbody", forum(lambda r: [n for n in below(r, "postbody") if n.tag == "div"], by_class("username-coloured", "username", "author", "postauthor"), found_date("postdate", "author"))),
    ("poster", forum(lambda r: [n for d in r.iter("div") if has(d, "post") for n in (below(d, "inner") or [d])[:1]], by_class("poster"), found_date("smalltext"), True)),
    ("replies", forum(lambda r: [n for n in r.iter() if has(n, "bbp-reply-content") or has(n, "bbp-topic-content")], by_class("bbp-author-name"), by_class("bbp-reply-post-date", "bbp-topic-post-date"))),
    ("messages", forum(lambda r: [n for n in r.iter("blockquote") if has(n, "messageText")], lambda b: next((n.get("data-author") for n in b.iter() if n.get("data-author")), ""), lambda b: next((n.get("title") or line(n) for n in below(b, "DateTime")), ""))),
    ("posted_by", posted_by),
    ("paired", paired),
    ("comments", comment_stream),
    ("collection", collection_item),
    ("song", song_sheet),
]


def handled(root: Node, html: str) -> tuple[str, list[Paragraph]] | None:
    """The first handler that knows the page, and its paragraphs."""
    for name, handler in HANDLERS:
        out = handler(root, html)
        if out is not None:
            return name, out
    return None


def comment_meta(root: Node) -> list[tuple[str, str, str]]:
    """(text, author, date) of blog comments; pingbacks don't count."""
    out = []
    for n in root.iter():
        if not re.fullmatch(r"comment-\d+", n.get("id")) or "pingback" in n.get("class") or "trackback" in n.get("class"):
            continue
        body = first(b for name in ("comment-content", "comment-body", "comment-text") for b in below(n, name))
        author = by_class("fn", "comment-author", "author")(n)
        if body is not None and author:
            out.append((line(body), author, tidy_date(by_class("comment-date", "comment-meta", "date")(n))))
    if len(out) >= 2:
        return out
    out = []
    for p in root.iter("p"):
        m = has(p, "comment-footer") and re.search(r"Posted by:?\s*(.+?)\s*\|\s*(.+)$", line(p))
        if m and p.parent is not None:
            earlier = [c for c in p.parent.children[: p.index()] if isinstance(c, Node) and has(c, "comment-content")]
            if earlier:
                out.append((line(earlier[-1]), m[1], m[2]))
    return out if len(out) >= 2 else []


def with_authors(kept: list[str], meta: list[tuple[str, str, str]]) -> list[tuple[int, str]]:
    """(position, inserted line): each comment's author goes before the first unused kept text that begins it."""
    used, out = set(), []
    for body, author, date in meta:
        flat = " ".join(body.split())
        for i, t in enumerate(kept):
            t = " ".join(t.split())
            if i not in used and t and flat.startswith(t[:60]):
                used.add(i)
                out.append((i, f"*{author}*" + (f" ({date})" if date else "") + ":"))
                break
    out.sort()
    if out and not any(t.strip() == "**Comments**" for t in kept):
        out.insert(0, (out[0][0], "**Comments**"))
    return out


def repository_fields(root: Node) -> list[str]:
    """Label: value lines of a repository item's table; several authors in one line."""
    t = first(t for t in root.iter("table") if has(t, "itemDisplayTable"))
    rows: dict[str, list[str]] = {}
    if t is not None:
        for tr in t.iter("tr"):
            cells = [line(c) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if len(cells) >= 2 and cells[0] and cells[1]:
                rows.setdefault(cells[0].rstrip(": "), []).append(cells[1])
    return [f"{k}: {'; '.join(v)}" for k, v in rows.items()]


def json_abstract(html: str) -> str:
    """The longest description or abstract in the page's structured data."""
    best = ""
    for raw in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html, re.S | re.I):
        try:
            data = json.loads(raw)
        except ValueError:
            continue
        best = max([best, *(v for _, v in values(data, "description", "abstract"))], key=len)
    return " ".join(re.sub("<[^>]*>", " ", best).split()) if len(best) >= 500 else ""


def slides(html: str) -> list[str]:
    out = []
    if "slidetype" not in html:
        return out
    for m in re.finditer(r'\{[^{}]*"?slidetype"?[^{}]*\}', html):
        try:
            data = json.loads(m[0])
        except ValueError:
            continue
        text = " ".join(re.sub("<[^>]*>", " ", " ".join(v for v in data.values() if isinstance(v, str) and len(v) > 20)).split())
        if text:
            out.append(text)
    return out


__all__ = ["comment_meta", "handled", "json_abstract", "repository_fields", "slides", "squeeze", "with_authors"]
