"""Queries over pages that are built from whole documents, so that SQL can say what must come out of them.

Each line of a document becomes one piece of markup, the kind of piece going round with the
line's number; what paragraphs a piece must give is listed beside it and counted up in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from winnowry.operators import paragraphs
from winnowry.plans import extract

LONG = "x" * 81
#: (markup, paragraphs that must come of it: text, path, characters in links, tags, verbatim?); $ is the line.
PIECES: list[tuple[str, list[tuple[str, str, str, int, bool]]]] = [
    ("<p>$</p>", [("$", "p", "0", 0, False)]),
    ("<h2>$</h2>", [("$", "h2", "0", 0, False)]),
    ("<p><a href='/x'>$</a> and <b>more</b></p>", [("$ and more", "p", "length", 2, False)]),
    ("<ul><li>$</li><li>item</li></ul>", [("- $\n- item", "ul", "0", 2, False)]),
    ("<div><ol><li>$</li><li>item</li></ol></div>", [("1. $\n2. item", "div", "0", 3, False)]),
    ("<ul class='main-nav'><li>$</li><li>item</li></ul>", [("$ item", "ul", "0", 2, False)]),
    ("<pre>\n$  x\n   y\n</pre>", [("$  x\n   y", "pre", "0", 0, True)]),
    ("<p>$<br>more</p>", [("$\nmore", "p", "0", 1, False)]),
    ("<p>$<br><br>more</p>", [("$", "p", "0", 0, False), ("more", "p.br", "0", 0, False)]),
    ("<div><script>var x = 1;</script><style>p {}</style><!-- none --><p>$</p><select><option>none</select></div>", [("$", "div.p", "0", 0, False)]),
    ("<blockquote>$\n  <i>in  it</i></blockquote>", [("$ in it", "blockquote", "0", 1, False)]),
    ("<dl><dt>$</dt><dd>meaning</dd></dl>", [("$ meaning", "dl", "0", 2, False)]),
    ("<table><tr><th>Name</th><th>N</th></tr><tr><td>$</td><td>1</td></tr><tr><td></td><td>-</td></tr></table>", [("Name | N\n--- | ---\n$ | 1\n&nbsp; | –", "pre", "0", 0, True)]),
    ("<p><a href='http://e.org/long/path/end'>http://e.org/lo...end</a> $</p>", [("http://e.org/long/path/end $", "p", "26", 1, False)]),
    ("<p>$ <img class='tex' alt='\\frac{a}{b} \\leq x^2'></p>", [("$ (a)/(b) ≤ x²", "p", "0", 1, False)]),
    ("<p>$<span class='tooltip' style='display:none'>hidden</span></p>", [("$", "p", "0", 0, False)]),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>$</td><td>1<b style='display: none'>9</b></td></tr><tr><td>c</td><td>2</td></tr></table>", [("A | B\n--- | ---\n$ | 1\nc | 2", "pre", "0", 0, True)]),
    ("<form><p>$</p><button>none</button><input value='none'></form>", [("$", "p", "0", 0, False)]),
    (
        "<table>" + "".join(f"<tr><td class='blob-num'>{i}</td><td>{c}</td></tr>" for i, c in enumerate(("$", "", "", "", "end"), 1)) + "</table>",
        [("$\n\nend", "pre", "0", 0, True)],
    ),
    (f"<div><code>$<br>{LONG}<br>z</code></div>", [(f"$\n{LONG}\nz", "div.pre", "0", 0, True)]),
    (
        "<table><tr><td>$</td></tr><tr><th>k</th><th>v</th><th>w</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td><td>5</td></tr></table>",
        [("$\n**k** | **v** | **w**\n--- | --- | ---\n1 | 2 | &nbsp;\n3 | 4 | 5", "pre", "0", 0, True)],
    ),
    ("<table><tr><td>Name:</td><td>Of:</td></tr><tr><td>$</td><td>1</td></tr><tr><td>a</td><td>b</td></tr></table>", [("Name: Of:\n$ 1\na b", "pre", "0", 0, True)]),
    ("<p>$ <me@mail.example.org></p>", [("$ <me@mail.example.org>", "p", "0", 0, False)]),
    ("<p>$ &amp;lt;b&amp;gt; &amp;amp; &lt;</p>", [("$ <b> & <", "p", "0", 0, False)]),
    ("<p>$ cafÃ©</p>", [("$ café", "p", "0", 0, False)]),
    ("<div>$<address>street</address></div>", [("$\nstreet", "div", "0", 1, False)]),
    ("<p>$<p>next", [("$", "p", "0", 0, False), ("next", "p", "0", 0, False)]),
    ("<div>  \n <p> </p>$</div>", [("$", "div", "0", 0, False)]),
    ("<textarea>none</textarea><iframe></iframe><object><p>none</p></object><p>$</p>", [("$", "p", "0", 0, False)]),
]


def base_lines():
    """A document's lines of letters, digits and single blanks, without empty ones."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    # runs found and joined cost a fifth of what putting a blank for all else does
    return F.filter(F.transform(lines, lambda x: F.array_join(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0)), " ")), lambda x: x != "")


BASE_SQL = "base as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))), lambda x: x <> '') as lines from documents)"


def put(markup: str, line):
    parts = markup.split("$")
    return F.concat(*(c for i, p in enumerate(parts) for c in ([line] if i else []) + [F.lit(p)]))


def built(docs):
    """(page_id, html): every document as a page."""

    def piece(line, i):
        kind = F.pmod(i + F.col("doc_id"), F.lit(len(PIECES)))
        out = put(PIECES[0][0], line)
        for k, (markup, _) in enumerate(PIECES[1:], 1):
            out = F.when(kind == k, put(markup, line)).otherwise(out)
        return out

    body = F.array_join(F.transform(base_lines(), piece), "")
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><head><title>none</title></head><body>"), body, F.lit("</body></html>")).alias("html"))


def built_paragraphs(spark, sf_dir):
    """Paragraphs of documents made into pages."""
    rows = paragraphs.from_pages(built(spark.read.parquet(f"{sf_dir}/documents.parquet")), variants=False)
    return rows.select("page_id", "idx", "text", "dom_path", "chars_in_links", "tags_count", "verbatim", "xpath")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def built_paragraphs_sql() -> str:
    cases = []
    for k, (_, found) in enumerate(PIECES):
        rows = []
        for text, path, links, tags, verbatim in found:
            value = " || ".join(x for i, p in enumerate(text.split("$")) for x in (["line"] if i else []) + ([quoted(p)] if p else [])) or "''"
            top = path.split(".")[0]
            rows.append(f"{{'text': {value}, 'path': '{path}', 'top': '{top}', 'links': {'length(line)' if links == 'length' else links}, 'tags': {tags}, 'verbatim': {verbatim}, 'own': {sum(m[1].split('.')[0] == top for m in found)}}}")
        cases.append(f"when {k} then [{', '.join(rows)}]")
    # a path's number counts the pieces' outermost tags before it; a piece of two paragraphs of one tag has two such tags unless the second one lies within the first
    return f"""with {BASE_SQL},
cut as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from base),
piece as (select *, case (i + doc_id) % {len(PIECES)} {" ".join(cases)} end as found from cut),
row as (select doc_id, i, unnest(found) as p, generate_subscripts(found, 1) as j, len(found) as n from piece),
numbered as (select *, row_number() over (partition by doc_id order by i, j) - 1 as idx,
  sum(case when p.path = p.top or j = 1 then 1 else 0 end) over (partition by doc_id, p.top order by i, j) as own from row)
select doc_id as page_id, idx::int as idx, p.text as text, 'html.body.' || p.path as dom_path, p.links::int as chars_in_links, p.tags::int as tags_count, p.verbatim as verbatim,
  '/html[1]/body[1]/' || p.top || '[' || own || ']' || case when strpos(p.path, '.') > 0 then '/' || string_split(p.path, '.')[2] || '[' || case when p.path = 'p.br' then 2 else 1 end || ']' else '' end as xpath from numbered"""


OPENING = ["How does one begin", "One begins like this", "And goes on so"]
PAD = "la " * 140
#: Kinds of pages that a handler knows: (its name, before the posts, the posts, after them; then what must come of it: before, of a post, and whether the first post is told apart). $ is a post's text, # its number.
SITES = [
    ("question", "<h1>T</h1>", "<div class='answer'><div class='post-text'><p>$</p></div><div class='owner'><div class='user-details'><a>user#</a></div></div></div>", "", ["T"], ["**Answer (user#)**", "$"]),
    ("postbit", "<h1>T</h1>", "<div><span class='username'>user#</span><span class='date'>12 Mar 2020</span><div id='post_message_#'><div class='quote'>none</div><p>$</p></div></div>", "", ["T"], ["**user#** (12 Mar 2020):", "$"]),
    ("threaded", "<script>", "pd[#]='<div><a class=\\'username\\'>user#<\\/a><div id=\\'post_message_#\\'>$<\\/div><\\/div>';", "</script>", [], ["user#: $"]),
    ("climbing", "<h2>T</h2>", "<div><b class='author'>user#</b> 12 Mar 2020 <div id='postmessage_#'>$</div></div>", "", ["T"], ["**user#** (12 Mar 2020):", "$"]),
    ("postbody", "", "<div><span class='postauthor'>user#</span><span class='postdate'>12 Mar 2020</span><div class='postbody'>$</div></div>", "", [], ["**user#** (12 Mar 2020):", "$"]),
    ("poster", "<h1>T</h1>", "<div class='post'><h5 class='poster'>user#</h5><div class='smalltext'>12 Mar 2020</div><div class='inner'>$</div></div>", "", ["T"], ["**user#** (12 Mar 2020):", "$"]),
    ("replies", "<h1>T</h1>", "<div><a class='bbp-author-name'>user#</a><i class='bbp-reply-post-date'>March 12th, 2020</i><div class='bbp-reply-content'><p>$</p></div></div>", "", ["T"], ["**user#** (March 12, 2020):", "$"]),
    ("messages", "<ul>", "<li data-author='user#'><blockquote class='messageText'>$</blockquote><i class='DateTime' title='Mar 12, 2020'>then</i></li>", "</ul>", [], ["**user#** (Mar 12, 2020):", "$"]),
    ("posted_by", "<h1>T</h1><ol>", "<li id='post_#'><div class='comment-by'>Posted by user# on 12 Mar 2020</div><p>$</p></li>", "</ol>", ["T"], ["**user#** (12 Mar 2020):", "$"]),
    ("paired", "<h1>T</h1><table>", "<tr><td><b class='authorName'>user#</b> 12 Mar 2020</td><td class='postbody'>$</td></tr>", "</table>", ["T"], ["**user#** (12 Mar 2020):", "$"]),
    ("comments", "<div class='copy'>Why so</div>", "<div class='comments'>$<br>posted by user# at 1:00 PM on March 12 [# favorites]</div>", "", ["Why so", "---"], ["**user#** (1:00 PM, March 12) [# favorites]:", "$"]),
    ("collection", '<script>window.__INITIAL_STATE__ = {"collectionAlias": "a", "item": [{"title": "T", "text": "', "$\\n\\n", PAD.strip() + '"}]};</script>', ["T"], ["$"]),
    ("song", '<script>UGAPP.store.page = {"content": "' + PAD, "[ch]$[/ch] ", 'end"};</script>', [], []),
]
#: The question page's own post, and what must come of it.
QUESTION = ("<div id='question'><div class='js-post-body'>$</div><div class='owner'><div class='user-details'><a>asker</a></div></div><span class='comment-copy'>Really</span></div>", ["**Question (asker)**", "$", "**Comments**", "- Really"])


def posts():
    return F.concat(F.array(*map(F.lit, OPENING)), base_lines())


def built_sites(docs):
    """(page_id, html): every document as a forum or archive page, its lines as posts."""

    def post(kind: int, text, i):
        def one(markup: str):
            parts = put(markup, text)
            return F.replace(parts, F.lit("#"), i.cast("string"))

        piece = one(SITES[kind][2])
        return F.when(i == 0, put(QUESTION[0], text)).otherwise(piece) if kind == 0 else piece

    def of_kind(k: int):
        return lambda x, i: post(k, x, i)

    out = None
    for k, (_, before, _, after, _, _) in enumerate(SITES):
        page = F.concat(F.lit(before), F.array_join(F.transform(posts(), of_kind(k)), ""), F.lit(after))
        hit = F.pmod(F.col("doc_id"), F.lit(len(SITES))) == k
        out = F.when(hit, page) if out is None else out.when(hit, page)
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><body>"), out, F.lit("</body></html>")).alias("html"))


def built_threads(spark, sf_dir):
    """Paragraphs of documents made into forum and archive pages."""
    rows = paragraphs.from_pages(built_sites(spark.read.parquet(f"{sf_dir}/documents.parquet")), variants=False)
    return rows.select("page_id", "idx", "route", "text")


def built_threads_sql() -> str:
    text = lambda t: " || ".join(x for i, p in enumerate(re.split(r"([$#])", t)) if p for x in ["line" if p == "$" else "i::varchar" if p == "#" else quoted(p)])
    cases = [f"when {k} then [{', '.join(map(text, site[5]))}]" for k, site in enumerate(SITES) if site[5]]
    heads = [f"when {k} then [{', '.join(map(quoted, site[4]))}]" for k, site in enumerate(SITES) if site[4]]
    n = len(SITES)
    return f"""with {BASE_SQL},
post as (select doc_id, unnest(list_concat([{', '.join(map(quoted, OPENING))}], lines)) as line, generate_subscripts(list_concat([{', '.join(map(quoted, OPENING))}], lines), 1) - 1 as i from base),
found as (select doc_id, i, case when doc_id % {n} = 0 and i = 0 then [{', '.join(map(text, QUESTION[1]))}] else case doc_id % {n} {" ".join(cases)} else [] end end as t from post
  union all select doc_id, -1, case doc_id % {n} {" ".join(heads)} else [] end from base
  union all select doc_id, 1 + count(*), [{quoted(PAD)} || string_agg(line, ' ' order by i) || ' end'] from post where doc_id % {n} = {n - 1} group by doc_id
  union all select doc_id, 1 + count(*), [{quoted(PAD.strip())}] from post where doc_id % {n} = {n - 2} group by doc_id),
row as (select doc_id, i, unnest(t) as text, generate_subscripts(t, 1) as j from found)
select doc_id as page_id, (row_number() over (partition by doc_id order by i, j) - 1)::int as idx, ([{', '.join(quoted(site[0]) for site in SITES)}])[doc_id % {n} + 1] as route, text from row"""


QUERIES = {"built_paragraphs": built_paragraphs, "built_threads": built_threads}


def oracles() -> dict[str, str]:
    return {"built_paragraphs": built_paragraphs_sql(), "built_threads": built_threads_sql()}
