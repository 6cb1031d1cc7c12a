"""Pages to paragraph rows: the one stage that runs in Python."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowry.functions import handlers, segment, text
from winnowry.functions.dom import parse

SCHEMA = (
    "page_id bigint, variant int, idx int, text string, text_nodes array<string>, dom_path string, xpath string, tags_count int, chars_in_links int, verbatim boolean, route string, synthetic boolean, error string"
)
FIELDS = ["page_id", "variant", "idx", "text", "text_nodes", "dom_path", "xpath", "tags_count", "chars_in_links", "verbatim", "route", "synthetic", "error"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
BATCH_CHARS = 4_000_000


def page_rows(page_id, html: str | None, forum_qa: bool = True, fix_encoding: bool = True, variants: bool = True, preprocessor=segment.clean) -> list[tuple]:
    """Rows of one page: variant 0 as it is, 1 its documents merged, 2 its long links as plain text.

    A page that a handler knows has its rows alone, by the handler's name as route. A page that
    can't be read gives one row with the error.
    """
    if not html or html.isspace():
        return []
    try:
        out = []
        source = segment.repaired(html) if fix_encoding else html
        root = parse(source)
        if forum_qa:
            # handlers change copies only, so the page needs no second parse
            hit = handlers.handled(root, source)
            if hit:
                return rows_of(page_id, 0, hit[1], hit[0])
        out += rows_of(page_id, 0, segment.paragraphs(segment.shaped(root, preprocessor)), "page")
        if variants:
            merged = segment.merged_documents(html)
            if merged:
                out += rows_of(page_id, 1, segment.paragraphs(segment.tree(merged, fix_encoding, preprocessor)), "page")
            root = segment.tree(html, fix_encoding, preprocessor)
            if segment.unwrap_long_links(root):
                out += rows_of(page_id, 2, segment.paragraphs(root), "page")
        return out
    except (ValueError, RecursionError, IndexError) as e:
        return [(page_id, 0, 0, "", [], "", "", 0, 0, False, "error", False, f"{type(e).__name__}: {e}"[:200])]


def rows_of(page_id, variant: int, found, route: str) -> list[tuple]:
    out = []
    for i, p in enumerate(found):
        t = p.text
        if not p.verbatim:
            t = text.ENTITY.sub(lambda m: unescape(m[0]), t) if "&" in t else t
        out.append((page_id, variant, i, t, p.nodes, p.dom_path, p.xpath, p.tags, p.link_chars, p.verbatim, route, p.synthetic, None))
    return out


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], FIELDS)


def from_pages(pages: DataFrame, forum_qa: bool = True, fix_encoding: bool = True, variants: bool = True, preprocessor=segment.clean, carry: str | None = None) -> DataFrame:
    """(page_id, html) to paragraph rows; a row-local map, so it serves streams as well. Null and blank pages give no row.

    carry names a string column of the pages that each of a page's rows gets.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in stream:
            rows, own, size = [], [], 0
            carried = batch.column(2).to_pylist() if carry else [None] * len(batch)
            for page_id, html, x in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), carried, strict=True):
                rows += page_rows(page_id, html, forum_qa, fix_encoding, variants, preprocessor)
                own += [x] * (len(rows) - len(own))
                size += len(html or "")
                if size > BATCH_CHARS:
                    yield with_own(to_batch(rows), own)
                    rows, own, size = [], [], 0
                    gc.collect()
            yield with_own(to_batch(rows), own)

    def with_own(batch: pa.RecordBatch, own: list) -> pa.RecordBatch:
        return batch.append_column(carry, pa.array(own, pa.string())) if carry else batch

    some = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html", *([carry] if carry else []))
    return some.mapInArrow(batches, SCHEMA + (f", {carry} string" if carry else ""))


def from_lines(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Lines of plain texts as paragraph rows, in expressions alone."""
    line = lambda x, i: F.struct(i.alias("idx"), text.squeezed(x).alias("text"))
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(body), F.lit("")), "\n"), line), lambda r: r["text"] != "")
    # blank lines go inside the array: a filter on the rows would be inferred through every later column
    rows = docs.select(F.col(key).alias("page_id"), *(c for c in docs.columns if c not in (key, body)), F.inline(lines))
    return rows.withColumns(
        {"variant": F.lit(0), "dom_path": F.lit("body.p"), "xpath": F.lit("/body[1]/p[1]"), "tags_count": F.lit(0), "chars_in_links": F.lit(0), "verbatim": F.lit(False), "route": F.lit("page"), "synthetic": F.lit(False)}
    )
