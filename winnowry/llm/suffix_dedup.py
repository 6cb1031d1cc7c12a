"""Exact substring deduplication by column-wise construction of a collection's Burrows-Wheeler transform.

A byte is removed if a string of SIZE bytes that covers it also starts earlier. Texts are first
cut into short blocks that are sorted together only where they can match: every string of SIZE
bytes holds the least hash of its GRAM-byte grams, equal strings hold equal ones, so only
strings around seeds that occur at least twice enter a block, and a seed's blocks meet in one
bucket. A block that a task has several times is sent once, the rest being repeats already.
Many blocks share a seed and no more; a seed's blocks are parted by how many bytes before it their
strings of SIZE bytes hold, and only parts that share more than the seed are sorted.

A bucket's blocks form a collection. Round j inserts, for every block of at least j bytes, the
suffix of length j: its place follows from the rank of its first byte in the transform so far,
its common prefix with its new neighbours from a range minimum over the previous round's common
prefixes. Transform and common prefixes lie in two files that each round reads and writes once,
in order. Runs of neighbours that share SIZE bytes are the equal strings; all but the earliest
are repeats.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_path, mix64, new_path, released, table
from .seeds import select

SIZE, GRAM = 100, 40
WINDOW = SIZE - GRAM + 1
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, by doubling."""
    with np.errstate(over="ignore"):
        h1 = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h2 = h1[:-1] * np.uint64(0xD6E8FEB86659FD93) + h1[1:]
        h4 = h2[:-2] * np.uint64(0xCA5A826395121157) + h2[2:]
        h8 = h4[:-4] * np.uint64(0x7FB5D329728EA185) + h4[4:]
        h16 = h8[:-8] * np.uint64(0x81DADEF4BC2DD44D) + h8[8:]
        h32 = h16[:-16] * np.uint64(0x99BCF6822B23CA35) + h16[16:]
        return mix64(h32[: len(raw) - GRAM + 1] * np.uint64(0xA24BAED4963EE407) + h8[32 : 32 + len(raw) - GRAM + 1])


@released
def seed_maker(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        hashes, docs, ats = [], [], []
        for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            if text is None or len(text) < SIZE:
                continue
            h = gram_hashes(np.frombuffer(text, np.uint8))
            at, _ = select(h, WINDOW)
            hashes.append(h[at])
            docs.append(np.full(len(at), d, np.int64))
            ats.append(at.astype(np.int32))
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(ats))], ["seed", "doc_id", "at"])


#: at: where the seed stands in the block; twice: whether it stands there again.
HEAD = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<i4"), ("seed", "<u8"), ("at", "u1"), ("twice", "u1")])
#: Bytes of blocks sorted in one collection, unless one seed that stands twice in a block has more.
COLLECTION = 150_000


def block_maker(buckets: int, flush: int = 24_000_000):
    """Blocks around repeated seeds, packed by bucket; (doc_id, start, end) where a task already has the block from earlier."""

    def out(held: dict[int, dict[bytes, tuple[int, int, int, int, bool]]], spans):
        rows = []
        for k, blocks in held.items():
            head = np.array([(d, s, len(b), seed, at, twice) for b, (d, s, seed, at, twice) in blocks.items()], HEAD)
            body = b"".join(blocks)
            rows.append((k, zstandard.compress(np.int64(len(head)).tobytes() + head.tobytes() + body, 3)))
        n = len(rows)
        doc, start, end = (zip(*spans, strict=True)) if spans else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows] + [None] * len(spans), pa.int32()),
                pa.array([b for _, b in rows] + [None] * len(spans), pa.binary()),
                pa.array([None] * n + list(doc), pa.int64()),
                pa.array([None] * n + list(start), pa.int64()),
                pa.array([None] * n + list(end), pa.int64()),
            ],
            ["bucket", "blob", "doc_id", "start", "end"],
        )

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, tuple[int, int, int, int, bool]]] = {}
        spans, size = [], 0
        for batch in stream:
            for d, text, ats in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), batch.column("ats").to_pylist(), strict=True):
                h = gram_hashes(np.frombuffer(text, np.uint8))
                _, low = select(h, WINDOW)
                n = len(low)
                for at in sorted(ats):
                    value = h[at]
                    a, b = max(0, at - WINDOW + 1), min(n, at + 1)
                    mine = np.flatnonzero(low[a:b] == value)  # the windows of which this is the least gram
                    a, b = a + int(mine[0]), a + int(mine[-1]) + SIZE
                    block, key = text[a:b], (d, a, int(value), at - a, bool(np.count_nonzero(h[a : b - GRAM + 1] == value) > 1))
                    bucket = held.setdefault(int(value % np.uint64(buckets)), {})
                    known = bucket.get(block)
                    if known is None:
                        bucket[block] = key
                        size += len(block) + 100
                    else:
                        bucket[block] = min(known, key)
                        later = max(known, key)
                        if known[:2] != key[:2]:
                            spans.append((later[0], later[1], later[1] + len(block)))
            if size > flush or len(spans) > 200_000:
                yield out(held, spans)
                held, spans, size = {}, [], 0
        if held or spans:
            yield out(held, spans)

    return batches


class Column:
    """(symbol, common prefix) rows in two files by turns: each round reads one in order and writes the other, piece by piece."""

    PIECE = 1 << 22

    def __init__(self, path: str, first: np.ndarray):
        self.paths = [path + "0", path + "1"]
        self.files = [open(x, "w+b", buffering=0) for x in self.paths]
        self.size = len(first)
        self.files[0].write(first.tobytes())

    def read(self) -> np.ndarray:
        self.files[0].seek(0)
        return np.fromfile(self.files[0], np.uint8, 2 * self.size).reshape(-1, 2)

    def close(self) -> None:
        for f, path in zip(self.files, self.paths, strict=True):
            f.close()
            os.remove(path)

    def write(self, old: np.ndarray, place: np.ndarray, new: np.ndarray) -> None:
        """Writes old with new put in so that it stands at place (sorted)."""
        total = len(old) + len(new)
        old, new = old.view(np.uint16).ravel(), new.view(np.uint16).ravel()
        self.files.reverse()
        self.files[0].seek(0)
        self.size, taken = total, 0
        for a in range(0, total, self.PIECE):
            b = min(a + self.PIECE, total)
            x, y = np.searchsorted(place, [a, b])
            out = np.empty(b - a, np.uint16)
            free = np.ones(b - a, bool)
            free[place[x:y] - a] = False
            out[place[x:y] - a] = new[x:y]
            n = b - a - (y - x)
            out[free] = old[taken : taken + n]
            taken += n
            self.files[0].write(out.tobytes())


def transform(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of a collection of strings over bytes below 255.

    Symbol 0 ends a string, a byte b is b + 1. Row i below n is string i's empty suffix.
    """
    n = len(ends)
    coded = text + np.uint8(1)
    os.makedirs(folder, exist_ok=True)
    file = Column(f"{folder}/rows", np.stack([coded[ends - 1], np.zeros(n, np.uint8)], 1))
    active = np.arange(n)
    place = np.arange(n)
    for j in range(1, int(sizes.max()) + 1):
        keep = sizes[active] >= j
        active, place = active[keep], place[keep]
        rows = file.read()
        b, p = np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1])
        order = np.argsort(b, kind="stable")  # rows by symbol: where the next round's suffixes stand
        first = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=256))])
        symbol = b[place]
        by = np.argsort(symbol, kind="stable")  # place rises, so this is the order of the new suffixes
        active, place, symbol = active[by], place[by], symbol[by]
        mine = np.empty(len(place), np.int64)
        cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
            if x < y:
                c = int(symbol[x])
                mine[x:y] = first[c] + np.searchsorted(order[first[c] : first[c + 1]], place[x:y])
        # common prefix with the neighbour above: one more than the least between the two rows that these suffixes continue
        before = order[np.maximum(mine - 1, 0)]
        up = (mine > 0) & (b[before] == symbol)
        pair = np.zeros((len(place), 2), np.uint8)
        pair[up, 1] = least(p, before[up] + 1, place[up] + 1) + 1
        after = order[np.minimum(mine + 1, len(b) - 1)]
        down = (mine + 1 < len(b)) & (b[after] == symbol)
        below = np.zeros(len(place), np.uint8)
        below[down] = least(p, place[down] + 1, after[down] + 1) + 1
        place = n + mine - first[1]
        at = place - np.arange(len(place))  # the old row they go before
        last = np.ones(len(at), bool)
        last[:-1] = place[1:] != place[:-1] + 1  # of rows put in side by side only the last has an old row below
        fix = (at < len(p)) & last
        rows[at[fix], 1] = below[fix]
        left = ends[active] - j - 1
        pair[:, 0] = np.where(sizes[active] > j, coded[np.maximum(left, 0)], 0)
        file.write(rows, place, pair)
    out = file.read()
    file.close()
    return np.ascontiguousarray(out[:, 0]), np.ascontiguousarray(out[:, 1])


def least(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of p within [start, end) for each pair; no pair is empty."""
    if not len(start):
        return np.empty(0, np.uint8)
    idx = np.stack([start, end], 1).ravel()
    return np.minimum.reduceat(np.append(p, np.uint8(0)), idx)[::2]


def repeats(blocks: list[bytes], doc: np.ndarray, start: np.ndarray, folder: str) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) runs of the blocks' bytes that repeat earlier ones."""
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    ends = np.cumsum(sizes)
    n = len(blocks)
    bwt, lcp = transform(np.frombuffer(b"".join(blocks), np.uint8), ends, sizes, folder)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    ended = int(np.count_nonzero(bwt == 0))
    group = np.cumsum(lcp < SIZE)
    # which rows the blocks' strings of SIZE bytes have: every suffix is one step from the next shorter one
    ids, rows, alive, row = [], [], np.arange(n), np.arange(n)
    for j in range(1, int(sizes.max()) + 1):
        keep = sizes[alive] >= j
        alive, row = alive[keep], n + rank[row[keep]] - ended
        if j >= SIZE:
            ids.append(np.stack([alive, sizes[alive] - j], 1))
            rows.append(row)
    ids, rows = np.concatenate(ids), np.concatenate(rows)
    which = group[rows]
    d, s = doc[ids[:, 0]], start[ids[:, 0]] + ids[:, 1]
    by = np.lexsort((s, d, which))
    which, d, s = which[by], d[by], s[by]
    again = np.zeros(len(by), bool)
    again[1:] = (which[1:] == which[:-1]) & ((d[1:] != d[:-1]) | (s[1:] != s[:-1]))
    # a string whose earliest row comes first; later rows of the same place are the same string
    d, s = d[again], s[again]
    by = np.lexsort((s, d))
    d, s = d[by], s[by]
    if not len(d):
        return []
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(d)) - 1
    return list(zip(d[a].tolist(), s[a].tolist(), (s[b] + SIZE).tolist(), strict=True))


def parted(blocks: dict[bytes, tuple[int, int, int]], spans: list[tuple[int, int, int]], low: int = 0, high: int = WINDOW - 1) -> Iterator[dict[bytes, tuple[int, int, int]]]:
    """What blocks (doc_id, start, the seed's place) around one seed have to be sorted: parts that can match, in groups of about COLLECTION bytes.

    A block's strings of SIZE bytes hold from low to high bytes before the seed. Halved by that
    number, those of one half share more than the seed: parts of blocks that differ there don't
    match. Equal parts are one, the later ones going to spans; what is alone has no repeat left.
    """
    middle = (low + high) // 2
    for x, y in ((low, middle), (middle + 1, high)):
        groups: dict[bytes, dict[bytes, tuple[int, int, int]]] = {}
        for block, (d, s, k) in blocks.items():
            before, least = min(y, k), max(x, k - len(block) + SIZE)
            if least > before:
                continue
            part, here = block[k - before : k - least + SIZE], (d, s + k - before, before)
            group = groups.setdefault(part[before - x : before - y + SIZE], {})
            known = group.setdefault(part, here)
            if known != here:
                group[part], later = min(known, here), max(known, here)
                spans.append((later[0], later[1], later[1] + len(part)))
        for group in groups.values():
            if len(group) > 1:
                if y - x > WINDOW // 4 or x < y and sum(map(len, group)) > COLLECTION:
                    yield from parted(group, spans, x, y)
                else:
                    yield group


def bucket_worker(folder: str):
    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in stream:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs.setdefault(k, []).append(blob)
        for k in list(blobs):
            place = f"{folder}/{k}-{uuid.uuid4().hex}"
            rows = work(blobs.pop(k), place)
            if os.path.isdir(place):
                os.rmdir(place)
            for a in range(0, len(rows), 100_000):
                doc, start, end = zip(*rows[a : a + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "start", "end"])

    def work(blobs: list[bytes], place: str) -> list[tuple[int, int, int]]:
        parts: dict[int, dict[bytes, tuple[int, int, int]]] = {}  # by seed
        spans, twice = [], set()
        for blob in blobs:
            raw = zstandard.decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            head = np.frombuffer(raw, HEAD, n, 8)
            at = 8 + n * HEAD.itemsize
            for d, s, size, seed, k, again in head.tolist():
                block = raw[at : at + size]
                at += size
                first = parts.setdefault(seed, {})
                if again:
                    twice.add(seed)
                known = first.setdefault(block, (d, s, k))
                if known[:2] != (d, s):
                    first[block], later = min(known, (d, s, k)), max(known, (d, s, k))
                    spans.append((later[0], later[1], later[1] + size))
        # equal strings hold the same seed: alone with its seed, and with it once, a block has no repeat left
        group: list[tuple[bytes, tuple[int, int, int]]] = []
        size = 0
        for seed in list(parts):
            first = parts.pop(seed)
            for some in [first] if seed in twice else parted(first, spans) if len(first) > 1 else ():
                group += some.items()
                size += sum(map(len, some))
                if size > COLLECTION:
                    spans += sort(group, place)
                    group, size = [], 0
        return spans + (sort(group, place) if group else [])

    def sort(group: list[tuple[bytes, tuple[int, int, int]]], place: str) -> list[tuple[int, int, int]]:
        blocks, at = zip(*group, strict=True)
        doc, start, _ = (np.array(x, np.int64) for x in zip(*at, strict=True))
        return repeats(list(blocks), doc, start, place)

    return batches


def rest_maker(kept: bool):
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for text, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, runs = text or b"", []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                rest = b"".join([*parts, text[at:]])
                rows.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest).hexdigest(), rest if kept else None))
            n, removed, count, sha, rest = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rest, pa.binary())][: 5 + kept], [*names, "kept"][: 5 + kept])

    return batches


def dedup(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document how many bytes repeat an earlier string of SIZE bytes, and what is left (kept, if with_bytes).

    Null and empty texts have no bytes. Rows without doc_id have no place in the order: nothing
    of them is removed or removes anything. Rows that share a doc_id are one document, of the
    smallest text among theirs. Other columns are dropped; an empty table gives no row.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_path(new_path(spark, "transform"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))
    if not rows.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.where("doc_id is null").unionByName(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("raw").alias("raw")))
    some = rows.where("doc_id is not null")
    seeds = some.where(F.length("raw") >= SIZE).mapInArrow(seed_maker, "seed bigint, doc_id bigint, at int")
    again = seeds.withColumn("n", F.count("*").over(Window.partitionBy("seed"))).where("n > 1").groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    placed = some.repartition(n, "doc_id")
    made = placed.join(again, "doc_id").mapInArrow(block_maker(2 * n), "bucket int, blob binary, doc_id bigint, start bigint, end bigint")
    made = table(made, "blocks", release=True)
    spans = made.where("bucket is null").select("doc_id", "start", "end")
    found = made.where("bucket is not null").select("bucket", "blob").repartition(n, "bucket").mapInArrow(bucket_worker(folder), "doc_id bigint, start bigint, end bigint")
    spans = spans.unionByName(found).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = placed.join(spans, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    return out.select("doc_id", "raw", "spans").mapInArrow(rest_maker(with_bytes), RESULT + ", kept binary" * with_bytes)
