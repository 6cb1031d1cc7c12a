"""Fuzzy substring deduplication: shared seeds, collinear chains, aligned passages.

Every run of SEED words is a seed. Of the documents that a task reads together, later holders of a
seed match the earliest one at once, and only that one goes on to the seed's bucket, to be matched
with the earliest document of all: however many texts share a seed, a bucket gets one of them for
each FLUSH seeds read. Matches travel in compressed blocks. Matches of a document with one earlier
document that follow each other in both are one run; runs are chained in order by dynamic
programming with a Fenwick tree over places in the earlier text: a chain's score falls with the
words between its runs. Chains are parted at wide gaps, aligned with the earlier text's words,
gaps and ends included, and parted again where the alignment is poor.

A seed is matched with one earlier document only, so of a passage that document B holds other
documents may take some seeds. What they take is either a passage of theirs or less than
LEAST_WORDS words long, and then the part that B keeps is extended over it (PAD is no less).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered_words, mix64, released, sieved, table
from .words import bounds, cut_batches, hashes, spans

SEED, PAD, DROP, FLUSH, NEAR, GROUP, MOST = 5, 40, 12, 1_500_000, 16, 500, 3_000_000
GAP_COST, LEAST_WORDS, IDENTITY = 0.1, 40, 0.8
LEAST_PAIRS = LEAST_WORDS * (2 * IDENTITY - 1) - 1
RESULT = "doc_id bigint, mark bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
PASS_ON = -1


def packed(*columns: np.ndarray) -> bytes:
    """int64 columns as compressed byte planes; all but the first as differences."""
    planes = [c if i == 0 else np.diff(c, prepend=0) for i, c in enumerate(columns)]
    return zstandard.compress(np.stack(planes).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), 1)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(n, 8, -1)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return [columns[0], *(np.cumsum(c) for c in columns[1:])]


def block_batch(bucket: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    """One compressed block of rows for each bucket, in the rows' order."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    blobs = [packed(*(c[order[x:y]].astype(np.int64) for c in columns)) for x, y in zip(cut, [*cut[1:], len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind, np.int32)), pa.array(bucket[cut].astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


def gathered(stream: Iterator[pa.RecordBatch], n: int, by: int) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket; those of a large one in parts of about MOST rows, by a hash of one of them."""
    blobs: dict[int, list[bytes]] = {}
    for batch in stream:
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            blobs.setdefault(k, []).append(blob)
    for k in list(blobs):
        some = blobs.pop(k)
        parts = sum(map(zstandard.frame_content_size, some)) // (8 * n * MOST) + 1
        for part in range(parts):
            found = [unpacked(b, n) for b in some]
            if parts > 1:
                hits = [np.flatnonzero(mix64(c[by].astype(np.uint64) + np.uint64(7)) % np.uint64(parts) == part) for c in found]
                found = [[x[hit] for x in c] for c, hit in zip(found, hits, strict=True)]
            yield [np.concatenate(x) for x in zip(*found, strict=True)]


def binaries(rows: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Rows of an array as one binary value for each stretch between cuts; cut holds 0 and the end."""
    width = rows.itemsize * int(np.prod(rows.shape[1:]))
    offsets = (cut * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def seeds_of(offsets: np.ndarray, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place of every run of SEED words in texts of LEAST_WORDS words or more."""
    size = np.diff(offsets)
    n = max(len(words) - SEED + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SEED):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        h = mix64(h)
    doc = np.repeat(np.arange(len(ids)), size)[:n]
    at = np.arange(n) - offsets[doc]
    keep = (at + SEED <= size[doc]) & (size[doc] >= LEAST_WORDS)
    return h[keep], ids[doc[keep]], at[keep]


def repeated(seed: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of seeds that occur more than once, sorted by seed, document and place; for each the row of its seed that comes first."""
    order = np.argsort(seed)
    same = seed[order[1:]] == seed[order[:-1]]
    keep = np.zeros(len(order), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    order = order[np.lexsort((at[order], doc[order], seed[order]))]
    s = seed[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    return order, order[np.repeat(start, np.diff(np.append(start, len(s))))]


def seed_maker(buckets: int):
    """Blocks of seeds for their buckets, and of matches among the documents read together."""

    def flush(held):
        h, d, a = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, first = repeated(h, d, a)
        later = d[first] < d[order]
        hit, first = order[later], first[later]
        keep = np.ones(len(h), bool)
        keep[hit] = False
        if len(hit):
            by = np.lexsort((a[hit], d[first], d[hit]))
            rows = [d[hit][by], d[first][by], a[hit][by], a[first][by]]
            yield block_batch(doc_bucket(rows[1], buckets), rows, PASS_ON)
            del rows, by
        del order, first, later, hit
        h, d, a = h[keep], d[keep], a[keep]
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        h >>= np.uint64(24)
        yield block_batch(bucket, [h, d, a], 0)

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in cut_batches(stream, "text", 1_000_000):
            h, d, a = seeds_of(*hashes(batch.column("text")), np.asarray(batch.column("doc_id")))
            held.append((h, d, a.astype(np.int32)))
            n += len(h)
            del h, d, a
            if n >= FLUSH:
                yield from flush(held)
                n = 0
        if n:
            yield from flush(held)

    return batches


def matcher(buckets: int):
    """Each seed met before, with its first occurrence (least document, then place) if that is in an earlier document."""

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seeds():
            for batch in stream:
                on = np.asarray(batch.column("kind")) == PASS_ON
                if on.any():
                    passed.append(batch.filter(pa.array(on)))
                yield batch.filter(pa.array(~on))

        passed: list[pa.RecordBatch] = []
        for seed, doc, at in gathered(seeds(), 3, 0):
            order, first = repeated(seed, doc, at)
            hit = doc[first] < doc[order]
            order, first = order[hit], first[hit]
            if len(order):
                by = np.lexsort((at[order], doc[first], doc[order]))
                order, first = order[by], first[by]
                yield block_batch(doc_bucket(doc[first], buckets), [doc[order], doc[first], at[order], at[first]], 0)
        yield from passed

    return batches


def runs_of(d: np.ndarray, e: np.ndarray, a: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """Matches that follow each other in both texts as runs: (document, earlier one, place, place there, seeds).

    Where a text repeats itself at close distance, as many runs begin at one place of the earlier
    text; of those within NEAR words one is enough, as its ends are extended over the others.
    """
    by = np.lexsort((a, a - o, e, d))
    d, e, a, o = (x[by] for x in (d, e, a, o))
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (a[1:] - a[:-1] != 1) | (o[1:] - o[:-1] != 1)
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(d)))
    d, e, a, o = (x[start] for x in (d, e, a, o))
    by = np.lexsort((-n, a // NEAR, o, e, d))
    d, e, a, o, n = (x[by] for x in (d, e, a, o, n))
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (o[1:] != o[:-1]) | (a[1:] // NEAR != a[:-1] // NEAR)
    d, e, a, o, n = (x[new] for x in (d, e, a, o, n))
    by = np.lexsort((o, a, e, d))
    return [x[by] for x in (d, e, a, o, n)]


def chains(at: list[int], other: list[int], size: list[int]) -> list[list[int]]:
    """Best chains of runs of matches (at, other, size), each rising in both; no run is in two.

    A run adds its words; a step from one to the next costs GAP_COST for each word it passes in
    either text. Prefix maxima over the runs' ends in the earlier text come from a Fenwick tree.
    """
    n = len(at)
    keys = sorted({o + s for o, s in zip(other, size, strict=True)})
    m = len(keys)
    tree = [(-1e18, -1)] * (m + 1)
    score, back = [0.0] * n, [-1] * n
    # at one place ends come before beginnings: a run may follow another that ends where it begins
    events = sorted([(at[i] + size[i], 0, i) for i in range(n)] + [(at[i], 1, i) for i in range(n)])
    for _, begins, i in events:
        if begins:
            r, best = bisect.bisect_right(keys, other[i]), (-1e18, -1)
            while r:
                if tree[r] > best:
                    best = tree[r]
                r &= r - 1
            joined = best[0] - GAP_COST * (at[i] + other[i])
            score[i] = SEED - 1 + size[i] + max(joined, 0.0)
            back[i] = best[1] if joined > 0 else -1
        else:
            value = (score[i] + GAP_COST * (at[i] + other[i] + 2 * size[i]), i)
            r = bisect.bisect_left(keys, other[i] + size[i]) + 1
            while r <= m:
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def parted(d: np.ndarray, e: np.ndarray, a: np.ndarray, o: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in the order of their chains, and which of them begin a part: chains are parted where more than PAD words lie between in either text."""
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1])))
    size = np.diff(np.append(cut, len(d)))
    order, new = np.arange(len(d)), np.zeros(len(d), bool)
    new[cut] = True
    many = size > 1
    for x, y in zip(cut[many].tolist(), (cut + size)[many].tolist(), strict=True):
        at = x
        for c in chains(a[x:y].tolist(), o[x:y].tolist(), n[x:y].tolist()):
            new[at] = True
            order[at : at + len(c)] = np.array(c) + x
            at += len(c)
    a, o, end = a[order], o[order], n[order] + (SEED - 1)
    new[1:] |= (a[1:] - a[:-1] - end[:-1] > PAD) | (o[1:] - o[:-1] - end[:-1] > PAD)
    return order, new


@released
def chainer(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of matches, by earlier document, to rows of such a document and the runs of up to GROUP parts in it."""
    for columns in gathered(stream, 4, 0):
        runs = runs_of(*columns)
        order, new = parted(*runs)
        runs = [c[order] for c in runs]
        part = np.cumsum(new)
        by = np.argsort(runs[1], kind="stable")
        rows = np.stack([runs[0], part, runs[2], runs[3], runs[4]], 1)[by]
        e = runs[1][by]
        first = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        inside = np.cumsum(new[by]) - np.repeat(np.cumsum(new[by])[first], np.diff(np.append(first, len(e))))
        group = inside // GROUP
        cut = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (group[1:] != group[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(e[cut]), binaries(rows, np.append(cut, len(e)))], ["other_id", "runs"])


@released
def slicer(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part: its runs and the words of the earlier text that it wants."""
    for batch in cut_batches(stream, "text"):
        offsets, words = hashes(batch.column("text"))
        words = (words >> np.uint64(33)).astype(np.int32)
        counts = batch.column("runs").buffers()
        sizes = np.diff(np.frombuffer(counts[1], np.int32, len(batch) + 1, batch.column("runs").offset * 4)) // 40
        runs = np.frombuffer(b"".join(batch.column("runs").to_pylist()), np.int64).reshape(-1, 5)
        row = np.repeat(np.arange(len(batch)), sizes)
        d, part, a, o, n = runs.T
        cut = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (d[1:] != d[:-1]) | (row[1:] != row[:-1])))
        last = np.append(cut[1:], len(d)) - 1
        row = row[cut]
        low = np.maximum(o[cut] - PAD, 0)
        high = np.minimum(o[last] + n[last] + SEED - 1 + PAD, np.diff(offsets)[row])
        for x in range(0, len(cut), 20_000):
            y = min(x + 20_000, len(cut))
            size = high[x:y] - low[x:y]
            bound = np.append(0, np.cumsum(size))
            where = np.repeat(offsets[row[x:y]] + low[x:y] - bound[:-1], size) + np.arange(bound[-1])
            u, v = cut[x], last[y - 1] + 1
            place = np.stack([a[u:v], o[u:v] - np.repeat(low[x:y], last[x:y] + 1 - cut[x:y]), n[u:v]], 1).astype(np.int32)
            arrays = [pa.array(d[cut[x:y]]), pa.array(np.asarray(batch.column("other_id"))[row[x:y]]), binaries(place, np.append(cut[x:y], v) - u), binaries(words[where], bound)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "other_id", "runs", "words"])


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], free: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of word lists the columns of its best alignment: (same words?, a word of the first list?).

    A column of equal words counts 1, every other one -1. free: the alignment may end anywhere
    in both, of equally good ends at the furthest. Pairs of like size are aligned side by side.
    """
    out: list = [None] * len(pairs)
    sizes = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    order = np.argsort(sizes, kind="stable")
    x = 0
    while x < len(order):
        y = min(x + 512, len(order))
        w = max(int(sizes[order[y - 1]]), 1)
        some = order[x:y]
        x = y
        k = len(some)
        a, b = np.full((k, w), -1, np.int64), np.full((k, w), -2, np.int64)
        for r, t in enumerate(some):
            p, q = pairs[t]
            a[r, : len(p)], b[r, : len(q)] = p, q
        cost = np.arange(w + 1, dtype=np.int32)
        score = np.empty((w + 1, k, w + 1), np.int32)
        score[0] = -cost
        equal = a.T[:, :, None] == b[None]
        for i in range(1, w + 1):
            here = score[i - 1] - 1
            np.maximum(here[:, 1:], score[i - 1][:, :-1] + np.where(equal[i - 1], 1, -1), out=here[:, 1:])
            score[i] = np.maximum.accumulate(here + cost, axis=1) - cost
        if free:
            value = (score * 256 + cost[:, None, None] + cost).transpose(1, 0, 2).reshape(k, -1)
            i, j = np.divmod(value.argmax(1), w + 1)
        else:
            i, j = (np.array([len(pairs[t][c]) for t in some]) for c in (0, 1))
        lane = np.arange(k)
        steps = []
        while (i + j).any():
            both = (i > 0) & (j > 0)
            same = both & equal[i - 1, lane, j - 1]
            now = score[i, lane, j]
            across = both & (score[i - 1, lane, j - 1] + np.where(same, 1, -1) == now)
            down = ~across & (i > 0) & ((j == 0) | (score[i - 1, lane, j] - 1 == now))
            right = ~across & ~down & (j > 0)
            steps.append((across & same, across | down, across | down | right))
            i, j = i - (across | down), j - (across | right)
        if steps:
            same, own, live = (np.stack(c)[::-1] for c in zip(*steps, strict=True))
        for r, t in enumerate(some):
            out[t] = (same[live[:, r], r], own[live[:, r], r]) if steps else (np.empty(0, bool), np.empty(0, bool))
    return out


def stretches(runs: list[list[int]]) -> list[tuple[int, int, int]]:
    """A part's runs of seeds as stretches (place, place in the earlier text, words) that don't overlap."""
    out: list[tuple[int, int, int]] = []
    x = y = -1
    for p, q, n in runs:
        n += SEED - 1
        skip = max(x - p, y - q, 0) if out else 0
        if skip < n:
            out.append((p + skip, q + skip, n - skip))
        x, y = max(x, p + n), max(y, q + n)
    return out


def pieces(same: np.ndarray) -> list[tuple[int, int]]:
    """The columns' stretches without any part in which DROP more columns differ than agree."""
    run = np.cumsum(np.where(same, 1, -1))
    if (np.maximum.accumulate(np.append(0, run)) - np.append(0, run)).max() < DROP:
        return [(0, len(same))]
    out, start, inside, best, end, low = [], 0, True, 0, 0, 0
    for i, v in enumerate(run.tolist(), 1):
        if inside:
            if v >= best:
                best, end = v, i
            elif best - v >= DROP:
                out.append((start, end))
                inside, low, start = False, v, i
        elif v <= low:
            low, start = v, i
        elif v - low >= SEED:
            inside, best, end = True, v, i
    return [(a, b) for a, b in [*out, *([(start, end)] if inside else [])] if b > a]


def alike(same: np.ndarray) -> list[tuple[int, int]]:
    """All stretches of LEAST_WORDS columns or more with IDENTITY, the longest from each of their beginnings."""
    n = len(same)
    starts = np.flatnonzero(same)
    if n < LEAST_WORDS or len(starts) < LEAST_WORDS * IDENTITY:
        return []
    high = np.append(0, np.cumsum(np.where(same, 1 - IDENTITY, -IDENTITY) * 1000).round().astype(np.int64))
    later = np.maximum.accumulate(high[::-1])[::-1]
    ends = np.searchsorted(-later, -high[starts], side="right") - 1
    last = np.maximum.accumulate(np.where(same, np.arange(1, n + 1), 0))
    ends = last[np.maximum(ends, 1) - 1]
    good = ends - starts >= LEAST_WORDS
    return list(zip(starts[good].tolist(), ends[good].tolist(), strict=True))


def merged(found: list[tuple[int, int]], near: int) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted(found):
        if runs and a <= runs[-1][1] + near:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Each two neighbouring words as one number."""
    w = words.astype(np.uint64)
    return w[:-1] << np.uint64(31) | w[1:]


def laned(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that differ from part to part, and their parts."""
    lane = np.repeat(np.arange(len(pairs), dtype=np.uint64), [len(x) for x in pairs])
    with np.errstate(over="ignore"):
        return mix64(np.concatenate(pairs) + lane * np.uint64(0x9E3779B97F4A7C15)), lane.astype(np.int64)


def passages(docs: list[tuple[np.ndarray, list[tuple[list, np.ndarray]]]]) -> list[list[tuple[int, int]]]:
    """For each document (words, parts) the spans of LEAST_WORDS words or more that are alike in one part's earlier text.

    A part is its runs and the words around them in the earlier text. Runs are joined by aligning
    the words between them; the ends are extended by up to PAD words with a gapped alignment. Of
    LEAST_WORDS columns at most a share of 1 - IDENTITY differ, so all but that share twice over,
    and one, are same words followed by same words: a part whose surroundings have fewer pairs of
    neighbouring words in common is none, whatever the alignment.
    """
    work, gaps, ends, near, theirs = [], [], [], [], []
    for k, (own, found) in enumerate(docs):
        pairs = pairs_of(own)
        for runs, other in found:
            part = stretches(runs)
            (a, b, _), (p, q, n) = part[0], part[-1]
            near.append(pairs[max(0, a - PAD) : p + n + PAD - 1])
            theirs.append(pairs_of(other[max(0, b - PAD) : q + n + PAD]))
            work.append((k, part, own, other))
    out: list[list[tuple[int, int]]] = [[] for _ in docs]
    if not work:
        return out
    keys, lane = laned(near)
    common = np.bincount(lane, np.isin(keys, laned(theirs)[0]), len(work))
    work = [work[i] for i in np.flatnonzero(common >= LEAST_PAIRS).tolist()]
    for _, part, own, other in work:
        for (p, q, n), (p2, q2, _) in zip(part, part[1:], strict=False):
            gaps.append((own[p + n : p2], other[q + n : q2]))
        (a, b, _), (p, q, n) = part[0], part[-1]
        ends.append((own[max(0, a - PAD) : a][::-1], other[max(0, b - PAD) : b][::-1]))
        ends.append((own[p + n : p + n + PAD], other[q + n : q + n + PAD]))
    between, beyond = iter(aligned(gaps, False)), iter(aligned(ends, True))
    for k, part, _, _ in work:
        same, own = next(beyond)
        columns = [(same[::-1], own[::-1])]
        start = part[0][0] - int(own.sum())
        for i, (_, _, n) in enumerate(part):
            if i:
                columns.append(next(between))
            columns.append((np.ones(n, bool), np.ones(n, bool)))
        columns.append(next(beyond))
        same, own = (np.concatenate(c) for c in zip(*columns, strict=True))
        place = start + np.append(0, np.cumsum(own))
        for a, b in pieces(same):
            out[k] += [r for r in merged([(int(place[a + x]), int(place[a + y])) for x, y in alike(same[a:b])], 0) if r[1] - r[0] >= LEAST_WORDS]
    return out


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, size of them for each start."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbouring words."""
    w = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])


#: Pairs of neighbouring words entered in a table of bits at once, and the bits of its size (in bytes).
ENTERED, TABLE = 1 << 18, 22


def likely(own: np.ndarray, own_at: np.ndarray, row: np.ndarray, runs: np.ndarray, runs_at: np.ndarray, other: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Which parts may have enough pairs of neighbouring words in common with the earlier text for passages() to keep them.

    Most parts are chance meetings, the more the larger the table; they end here, many at a time.
    A part's words of the earlier text enter a table by hash, so that clashes let more parts pass
    but none go. row: a part's text; own_at, runs_at and other_at: bounds of texts' words, of
    parts' runs and of parts' earlier words.
    """
    n = len(row)
    low = own_at[row] + np.maximum(runs[runs_at[:-1], 0] - PAD, 0)
    high = np.maximum.reduceat(runs[:, 0] + runs[:, 2], runs_at[:-1]) + (SEED - 1 + PAD)
    size = np.maximum(np.minimum(own_at[row] + high, own_at[row + 1]) - low - 1, 0)
    entered = np.maximum(np.diff(other_at) - 1, 0)
    ours, theirs = pair_hashes(own), pair_hashes(other)
    so_far = np.cumsum(np.maximum(entered, size))
    table = np.zeros(1 << TABLE, bool)
    common = np.zeros(n, np.int64)
    x = 0
    while x < n:
        y = max(x + 1, int(np.searchsorted(so_far, (so_far[x - 1] if x else 0) + ENTERED, side="right")))
        salt = mix64(np.arange(x, y, dtype=np.uint64))
        keys = ((theirs[places(other_at[x:y], entered[x:y])] ^ np.repeat(salt, entered[x:y])) & np.uint64((1 << TABLE) - 1)).astype(np.int64)
        table[keys] = True
        hit = table[((ours[places(low[x:y], size[x:y])] ^ np.repeat(salt, size[x:y])) & np.uint64((1 << TABLE) - 1)).astype(np.int64)]
        table[keys] = False
        common[x:y] = np.bincount(np.repeat(np.arange(y - x), size[x:y]), hit, y - x)
        x = y
    return common >= LEAST_PAIRS


def likely_parts(column: pa.Array, own_at: np.ndarray, own: np.ndarray) -> dict[int, list[tuple[list, np.ndarray]]]:
    """The likely() parts (runs, words of the earlier text) of each row that has any."""
    counts = np.asarray(column.value_lengths().fill_null(0))
    runs, other = column.flatten().flatten()
    if not len(runs):
        return {}
    row = np.repeat(np.arange(len(column)), counts)
    at, raw = spans(runs)
    runs, runs_at = raw[at[0] : at[-1]].view("<i4").reshape(-1, 3).astype(np.int64), (at - at[0]) // 12
    at, raw = spans(other)
    other, other_at = raw[at[0] : at[-1]].view("<i4"), (at - at[0]) // 4
    out: dict[int, list] = {}
    for i in np.flatnonzero(likely(own, own_at, row, runs, runs_at, other, other_at)).tolist():
        out.setdefault(int(row[i]), []).append((runs[runs_at[i] : runs_at[i + 1]].tolist(), other[other_at[i] : other_at[i + 1]].astype(np.int64)))
    return out


@released
def aligner(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut_batches(stream, "text", 2_000_000, 512):
        at, raw = spans(batch.column("text"))
        start, end, offsets = bounds(raw, at)
        size = np.diff(offsets)
        spans_of: list[list] = [[] for _ in range(len(batch))]
        if len(batch) > batch.column("parts").null_count:
            own_at, words = hashes(batch.column("text"))
            words = (words >> np.uint64(33)).astype(np.int64)
            found = likely_parts(batch.column("parts"), own_at, words)
            docs = [(words[own_at[i] : own_at[i + 1]], parts) for i, parts in found.items()]
            for i, spans_ in zip(found, passages(docs), strict=True):
                spans_of[i] = merged(spans_, 2)
        rest, shas = [], []
        for i, runs in enumerate(spans_of):
            if not runs:
                rest.append(None)
                shas.append(hashlib.sha256(raw[at[i] : at[i + 1]]).hexdigest())
                continue
            keep, x = [], int(at[i])
            for a, b in runs:  # a run of words goes with the white space behind it
                keep.append(raw[x : start[offsets[i] + a]])
                x = int(start[offsets[i] + b]) if b < size[i] else int(at[i + 1])
            left = b"".join(k.tobytes() for k in [*keep, raw[x : at[i + 1]]])
            shas.append(hashlib.sha256(left).hexdigest())
            rest.append(left.decode("utf-8"))
        removed = [sum(b - a for a, b in r) for r in spans_of]
        arrays = [batch.column("doc_id"), batch.column("mark"), pa.array(size.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(list(map(len, spans_of)), pa.int64()), pa.array(shas, pa.string()), pa.array(rest, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut_passages(docs: DataFrame) -> DataFrame:
    """RESULT for (doc_id bigint, text string) rows of unique doc_ids: mark is a hash of the text, kept what is left of it if words go, else null."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a bucket of seeds is sorted in memory: about 2 million at most
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(2 * n, chars // 12_000_000)
    kinds = "kind int, bucket int, blob binary"
    seeds = docs.mapInArrow(seed_maker(buckets), kinds).repartition(buckets // 2, "bucket")
    met = seeds.mapInArrow(matcher(buckets), kinds).repartition(buckets // 2, "bucket")
    # a row holds the parts of GROUP documents at most: a much repeated text is read once for that many
    wanted = table(met.mapInArrow(chainer, "other_id bigint, runs binary"), "chains", release=True)
    placed = docs.repartition(n, "doc_id")
    theirs = placed.withColumnRenamed("doc_id", "other_id").join(wanted, "other_id")
    cut = theirs.select("other_id", "text", "runs").mapInArrow(slicer, "doc_id bigint, other_id bigint, runs binary, words binary")
    # a document's parts are no more than its words
    parts = cut.groupBy("doc_id").agg(F.collect_list(F.struct("runs", "words")).alias("parts"))
    return placed.join(parts, "doc_id", "left").select("doc_id", F.xxhash64("text").alias("mark"), "text", "parts").mapInArrow(aligner, RESULT)


def documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text) of unique doc_ids, of shared ones the smallest text; whether any is shared."""
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    if some.groupBy("doc_id").count().where("count > 1").isEmpty():
        return some, False
    return some.groupBy("doc_id").agg(F.min("text").alias("text")), True


def dedup(docs: DataFrame) -> DataFrame:
    """Per row how many words lie in passages that repeat those of an earlier document (smaller doc_id), and a digest of what is left.

    A passage is LEAST_WORDS words or more that align with one stretch of one earlier document,
    IDENTITY of the columns the same words in order, A-Z lower-cased. Repeats within one document
    don't count. Null and empty texts have no words. Rows without doc_id have no place in the
    order and keep all. Of rows that share a doc_id the smallest text is the document: rows that
    hold it (repeated ones) share its result, the others keep all. Other columns are dropped; an
    empty table gives no row.
    """
    texts, shared = documents(docs)
    found = cut_passages(texts)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if shared:
        rows = rows.join(found.withColumnRenamed("doc_id", "id"), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("mark")), "left")
    else:
        rows = rows.where("doc_id is null").unionByName(found, allowMissingColumns=True)
    whole = F.sha2(F.encode("text", "UTF-8"), 256)
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_removed", "n_spans")]
    return rows.select("doc_id", F.coalesce("n_words", F.size(lowered_words(F.col("text")))).cast("bigint").alias("n_words"), *counts, F.coalesce("kept_sha256", whole).alias("kept_sha256"))


def cut(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, text (and n_chars, if there is one) without the words that dedup() removes.

    Nulls, empty texts, shared and null doc_ids are as in dedup(): every row stays, and its text
    unless it holds a repeated passage.
    """
    found = cut_passages(documents(docs)[0]).where("n_removed > 0").select(F.struct("doc_id", "mark", "kept").alias("found"))
    found = table(found, "cut", release=True)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    text = F.col("row.text").cast("string")
    doc_id, mark = F.col("row.doc_id").cast("bigint"), F.xxhash64(F.coalesce(text, F.lit("")))
    possible, others = sieved(rows, F.xxhash64(doc_id, mark), found, F.xxhash64("found.doc_id", "found.mark"))
    rows = possible.join(found, (doc_id == F.col("found.doc_id")) & (mark == F.col("found.mark")), "left").unionByName(others, allowMissingColumns=True)
    left = {"text": F.coalesce("found.kept", text), "n_chars": F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.char_length("found.kept").cast("bigint")) if "n_chars" in docs.columns else None}
    return rows.select(*((left[c] if c in left else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
