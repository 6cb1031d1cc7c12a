"""Interpolated modified Kneser-Ney model of any order from two: counted in Spark, memory-mapped for scoring.

Counting: tasks send each bucket of contexts one compressed block of the grams they saw with
counts; a bucket's blocks are added up and stored, and the bucket sends the next lower order its
grams with the numbers of distinct words before them. Grams that begin a text have their own
counts instead, as nothing precedes them. Words are 56-bit hashes. A bucket is one file of sorted
arrays: contexts by 64-bit hash, of which a table of small slots and 32 further bits are kept, and
grams likewise, with counts. A context seen once, as most are, is stored with 32 bits of its one
next word; others have what interpolation needs. Small numbers take a byte, larger
ones stand in a list of exceptions. Files lie in the shared folder, which must be mounted on the
workers; scoring maps them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, local_path, mix64, new_path, released, table
from .words import cut_batches, hashes

MASK = np.uint64((1 << 56) - 1)
BEGIN, END = np.uint64(0x00B5297A4D3F1C69), np.uint64(0x00D1B54A32D192ED)
FLUSH, SHARES = 2_500_000, 8
ORDER = 3
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
#: What counting passes on: blocks of grams for a bucket; or, with bucket -1, numbers of a kind: 0 a word's, FEW grams by count, STORED a bucket's grams.
ROWS = "bucket int, blob binary, kind int, word bigint, follows bigint, n bigint"
FEW, STORED = 1, 2


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def context(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = pair_keys(h, c)
    return mix64(h) if len(columns) == 1 else h


def tokens_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's tokens (its words and one end), their places in it, and numbers of tokens."""
    offsets, values = hashes(batch.column("text"))
    n = len(offsets) - 1
    size = np.diff(offsets) + 1
    ends = np.cumsum(size) - 1
    token = np.empty(int(size.sum()), np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = (values[offsets[0] : offsets[-1]] if n else values[:0]) & MASK
    token[ends] = END
    return token, np.arange(len(token)) - np.repeat(ends - size + 1, size), size


def grams(token: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """The columns of the grams that end in each token."""
    columns = [token]
    for back in range(1, order):
        left = np.full(len(token), BEGIN)
        left[back:] = token[: max(len(token) - back, 0)]
        left[place < back] = BEGIN
        columns.insert(0, left)
    return columns


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(columns: list[np.ndarray], follows: np.ndarray | None = None, raw: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(columns, context hashes, follows, raw) of the distinct grams, sorted by context; numbers that aren't given are ones."""
    left = context(columns[:-1])
    key = pair_keys(left, columns[-1])
    order = np.argsort(key)
    key = key[order]
    at = runs(key)
    size = np.diff(np.append(at, len(key)))
    del key
    follows, raw = ((np.add.reduceat(x[order], at, dtype=np.int64) if len(at) else x.astype(np.int64)) if x is not None else size for x in (follows, raw))
    first = order[at]
    left = left[first]
    order = np.argsort(left)
    first = first[order]
    for i in range(len(columns)):  # one after the other: the old ones go as the new ones come
        columns[i] = columns[i][first]
    return columns, left[order], follows[order], raw[order]


def planes(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplaned(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind)[:, 0] if n else np.empty(0, kind)


def thin(x: np.ndarray) -> np.ndarray:
    """Numbers in the fewer bytes where sums of them can't grow too large."""
    return x.astype(np.int32) if not len(x) or x.sum() < 1 << 31 else x


def packed(columns: list[np.ndarray], follows: np.ndarray, raw: np.ndarray) -> bytes:
    """Distinct words by differences, grams as numbers of words in sorted order, the first ones by differences."""
    words, index = np.unique(np.concatenate(columns), return_inverse=True)
    index = index.reshape(len(columns), -1).astype(np.uint32)
    width = np.uint64(max(len(words).bit_length(), 1))
    if width * len(columns) <= 64:
        key = index[0].astype(np.uint64)
        for x in index[1:]:
            key = key << width | x
        order = np.argsort(key)
    else:
        order = np.lexsort(index[::-1])
    index = index[:, order]
    index[0] = np.diff(index[0], prepend=np.uint32(0))
    parts = [np.array([len(words), len(raw), len(columns)], np.int64).tobytes(), planes(np.diff(words, prepend=np.uint64(0)))]
    parts += [planes(x) for x in (*index, follows[order], raw[order])]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(blob: bytes):
    raw = zstandard.decompress(blob)
    v, m, k = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    words = np.cumsum(unplaned(raw, np.uint64, v, 24), dtype=np.uint64)
    at = 24 + 8 * v
    index = [unplaned(raw, np.uint32, m, at + 4 * m * i) for i in range(k)]
    index[0] = np.cumsum(index[0], dtype=np.uint32)
    at += 4 * m * k
    return [words[i] for i in index], *(thin(unplaned(raw, np.int64, m, at + 8 * m * i)) for i in (0, 1))


def gathered(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of several blocks, put together column by column so that they aren't all held twice."""
    found = []
    while blobs:
        columns, follows, raw = unpacked(blobs.pop())
        found.append([*columns, follows, raw])
    out = []
    for i in range(len(found[0])):
        out.append(np.concatenate([f[i] for f in found]))
        for f in found:
            f[i] = None
    return out[:-2], out[-2], out[-1]


def rows(bucket=None, blob=None, kind=0, word=None, follows=None, n=None) -> pa.RecordBatch:
    """A batch of ROWS: of blocks, or of numbers."""
    size = len(word if bucket is None else bucket)
    none = lambda t: pa.nulls(size, t)
    if bucket is not None:
        arrays = [pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), none(pa.int32()), *(none(pa.int64()) for _ in range(3))]
    else:
        arrays = [pa.array(np.full(size, -1, np.int32)), none(pa.binary()), pa.array(np.full(size, kind, np.int32)), *(pa.array(np.asarray(x).astype(np.int64)) for x in (word, follows, n))]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "blob", "kind", "word", "follows", "n"])


def block_rows(buckets: int, columns, left, follows, raw) -> pa.RecordBatch:
    """A block for each bucket of the next step: context % buckets."""
    part = (left % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = runs(part)
    blobs = [packed([c[order[x:y]] for c in columns], follows[order[x:y]], raw[order[x:y]]) for x, y in zip(at, [*at[1:], len(order)], strict=True)]
    return rows(part[at], blobs)


def counter(buckets: int, order: int):
    def flush(held):
        token = np.concatenate([t for t, _ in held])
        place = np.concatenate([p for _, p in held])
        held.clear()
        columns = grams(token, place, order)
        del token, place
        # a share of the buckets at a time: a gram's context tells its bucket, so that the blocks are those of all grams at once
        share = context(columns[:-1]) % np.uint64(buckets) * np.uint64(SHARES) // np.uint64(buckets)
        by = np.argsort(share.astype(np.uint8), kind="stable").astype(np.int32)
        bounds = np.append(0, np.cumsum(np.bincount(share.astype(np.int64), minlength=SHARES)))
        del share
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if x < y:
                yield block_rows(buckets, *summed([c[by[x:y]] for c in columns]))

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in cut_batches(stream, "text", 1_000_000):
            token, place, _ = tokens_of(batch)
            held.append((token, place.astype(np.int32)))
            n += len(token)
            del token, place
            if n >= FLUSH:
                yield from flush(held)
                n = 0
        if n:
            yield from flush(held)

    return batches


def slotted(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted 64-bit keys as starts of slots by their first bits, a few keys each, and the 32 bits after those."""
    bits = min(max(len(keys) // 8, 1).bit_length(), 28)
    slots = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [slots.astype(np.uint32), first_bits(keys << np.uint64(bits))]


def first_bits(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.uint32)


def narrow(values: np.ndarray) -> list[np.ndarray]:
    """Numbers in one byte each, and where and what those are that need more."""
    at = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype(np.uint8), at.astype(np.uint32), values[at].astype(np.uint64)]


LAYOUT = [
    *((k, "u4") for k in ("single_slots", "single_keys", "single_word", "left_slots", "left_keys", "gram_slots", "gram_keys")),
    *((k + e, t) for k in ("total", "ones", "twos", "more", "count") for e, t in (("", "u1"), ("_at", "u4"), ("_value", "u8"))),
]


def save(path: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays after a list of their lengths, whole or not at all: a repeated task writes the same file again."""
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}.{os.getpid()}"
    with open(part, "wb") as f:
        f.write(np.array([len(arrays), *map(len, arrays)], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(part, f"{path}/{name}")


def mapped(maps: dict, path: str, name: str, layout: list) -> dict[str, np.ndarray]:
    """A file's arrays, mapped; a file that ought to be there and isn't is an error."""
    if name not in maps:
        raw = np.memmap(f"{path}/{name}", np.uint8, "r").view(np.ndarray)
        n = int(raw[:8].view(np.int64)[0])
        sizes = raw[8 : 8 + 8 * n].view(np.int64).tolist()
        at, out = 8 + 8 * n, {}
        for (key, kind), size in zip(layout, sizes, strict=True):
            width = size * int(kind[1])
            out[key] = raw[at : at + width].view(kind)
            at += width + -width % 8
        maps[name] = out
    return maps[name]


def store(path: str, name: str, left: np.ndarray, right: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stores grams sorted by context and scrambled last word; returns the numbers of those with counts 1 to 4."""
    at = runs(left)
    kinds = np.diff(np.append(at, len(left)))
    single = (kinds == 1) & (count[at] == 1)
    rest = np.ones(len(left), bool)
    rest[at[single]] = False
    many = at[~single]
    add = lambda x: np.add.reduceat(x.astype(np.int64), at)[~single] if len(at) else np.empty(0, np.int64)
    if len(left) >= 1 << 32:
        raise ValueError("a bucket is too large: raise spark.sql.shuffle.partitions")
    keys = pair_keys(left[rest], right[rest])
    order = np.argsort(keys)
    arrays = [*slotted(left[at[single]]), first_bits(mix64(right[at[single]])), *slotted(left[many]), *slotted(keys[order])]
    for values in (add(count), add(count == 1), add(count == 2), add(count > 2), count[rest][order]):
        arrays += narrow(values)
    save(path, name, arrays)
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5]


def bucket_writer(path: str, buckets: int, size: int, top: bool):
    """Stores the grams of size words and passes on those one word shorter: as blocks, or as words with numbers."""

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in stream:
            number = np.asarray(batch.column("bucket"))
            if (number < 0).any():
                yield batch.filter(pa.array(number < 0))
            for k, blob in zip(number.tolist(), batch.column("blob").to_pylist(), strict=True):
                if k >= 0:
                    blobs.setdefault(k, []).append(blob)
        for k in list(blobs):
            columns, left, follows, raw = summed(*gathered(blobs.pop(k)))
            # with two begins, a gram is a shorter one at the start of a text
            whole = (columns[1] != BEGIN) if size > 2 else np.ones(len(raw), bool)
            count = raw if top else np.where(columns[0] == BEGIN, raw, follows)
            few = store(path, f"{size}-{k}", left[whole], columns[-1][whole], count[whole])
            yield rows(kind=10 * size + FEW, word=np.arange(1, 5), follows=few, n=np.zeros(4))
            yield rows(kind=10 * size + STORED, word=[k], follows=[int(whole.sum())], n=[0])
            del left, follows, count, whole
            if size > 2:
                yield block_rows(buckets, *summed(columns[1:], np.ones(len(raw), np.int64), raw))
            else:
                order = np.argsort(columns[1])
                r, c = columns[1][order], raw[order]
                at = runs(r)
                yield rows(word=r[at], follows=np.diff(np.append(at, len(r))), n=np.add.reduceat(c, at))

    return batches


WORDS = [("key", "u8"), ("follows", "u1"), ("follows_at", "u4"), ("follows_value", "u8"), ("n", "u1"), ("n_at", "u4"), ("n_value", "u8")]


def word_writer(path: str):
    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(i)) for i in range(4)] for b in stream]
        if not parts:
            return
        bucket, word, follows, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((word, bucket))
        bucket, word, follows, n = (x[order] for x in (bucket, word, follows, n))
        at = runs(bucket)
        for x, y in zip(at, [*at[1:], len(bucket)], strict=True):
            save(path, f"1-{bucket[x]}", [word[x:y].astype(np.uint64), *narrow(follows[x:y]), *narrow(n[x:y])])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at])], ["bucket"])

    return batches


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of grams with counts 1 to 4; fixed ones where those are too few."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def fit(texts: DataFrame, order: int = ORDER) -> dict:
    """Counts (text string) rows and stores the model; returns its description, with the buckets that have files."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = local_path(new_path(spark, "kneser-ney"))
    found, before = texts.select("text").mapInArrow(counter(buckets, order), ROWS), None
    for size in range(order, 1, -1):
        # numbers, which are for the driver and for words, keep to any task
        spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("kind", "word"), F.lit(buckets)).cast("int"))
        found = table(found.repartition(buckets, spread).mapInArrow(bucket_writer(path, buckets, size, size == order), ROWS), "grams", release=True)
        if before is not None:
            drop_table(before)
        before = found
    gathered = table(found.groupBy("kind", "word").agg(F.sum("follows").alias("follows"), F.sum("n").alias("n")), "words")
    drop_table(before)
    few: dict[int, dict[int, int]] = {}
    stored: dict[int, set[int]] = {1: set()}
    # 4 rows an order, and one for each of its buckets
    for r in gathered.where("kind > 0").collect():
        if r.kind % 10 == FEW:
            few.setdefault(r.kind // 10, {})[r.word] = r.follows
        else:
            stored.setdefault(r.kind // 10, set()).add(r.word)
    vocabulary = gathered.where("kind = 0")
    s = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("follows"), F.lit(0)).alias("f"), *(F.count_if(F.col("follows") == i).alias(f"f{i}") for i in range(1, 5))).first()
    bucket = F.pmod(F.col("word"), F.lit(buckets)).cast("int").alias("bucket")
    written = vocabulary.select(bucket, "word", "follows", "n").repartition(buckets, "bucket").mapInArrow(word_writer(path), "bucket int")
    stored[1] = {r.bucket for r in written.collect()}
    d = {size: discounts([few.get(size, {}).get(i, 0) for i in range(1, 5)]) for size in range(2, order + 1)}
    return {"path": path, "buckets": buckets, "stored": stored, "v": s.v, "n": s.n, "follows": s.f, "order": order, "d": d, "d1": discounts([s.f1, s.f2, s.f3, s.f4]), "few": [s.f1, s.f2, s.v - s.f1 - s.f2]}


def sought(t: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
    """Where 64-bit keys stand among slotted() ones, -1 if they don't."""
    slots, stored = t[f"{name}_slots"], t[f"{name}_keys"]
    out = np.full(len(keys), -1)
    if not len(stored):
        return out
    bits = np.uint64((len(slots) - 1).bit_length() - 1)
    slot = (keys >> (np.uint64(64) - bits)).astype(np.int64)
    wanted = first_bits(keys << bits)
    at, end = slots[slot].astype(np.int64), slots[slot + 1].astype(np.int64)
    live = np.flatnonzero(at < end)
    while len(live):  # a slot holds few keys: one after the other
        here = at[live]
        value, own = stored[here], wanted[live]
        same = value == own
        out[live[same]] = here[same]
        live = live[value < own]
        at[live] += 1
        live = live[at[live] < end[live]]
    return out


def wide(t: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The narrow() numbers at those places."""
    out = t[name][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = t[name + "_value"][np.searchsorted(t[name + "_at"], at[large])]
    return out


def grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    at = runs(bucket[order])
    for x, y in zip(at, [*at[1:], len(order)], strict=True):
        yield int(bucket[order[x]]), order[x:y]


def discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def looked_up(model: dict, maps: dict, size: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram its count and its context's (total, grams of count 1, 2, 3 or more)."""
    stats, count = np.zeros((len(left), 4), np.int64), np.zeros(len(left), np.int64)
    for k, tokens in grouped(left % np.uint64(model["buckets"])):
        if k not in model["stored"].get(size, ()):
            continue
        t = mapped(maps, model["path"], f"{size}-{k}", LAYOUT)
        lefts, where = np.unique(left[tokens], return_inverse=True)
        single = sought(t, "single", lefts)
        many = sought(t, "left", lefts)
        own = np.zeros((len(lefts), 4), np.int64)
        own[single >= 0] = (1, 1, 0, 0)
        has = many >= 0
        own[has] = np.stack([wide(t, name, many[has]) for name in ("total", "ones", "twos", "more")], 1)
        stats[tokens] = own[where]
        alone = single[where]
        hit = np.flatnonzero(alone >= 0)
        count[tokens[hit]] = t["single_word"][alone[hit]] == first_bits(mix64(right[tokens[hit]]))
        some = tokens[has[where]]
        place = sought(t, "gram", pair_keys(left[some], right[some]))
        hit = place >= 0
        count[some[hit]] = wide(t, "count", place[hit])
    return count, stats


def probabilities(model: dict, maps: dict, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(last word | those before) of the model, and each last word's count in training."""
    right = columns[-1]
    words, back = np.unique(right, return_inverse=True)
    stat = np.zeros((len(words), 2), np.int64)
    for k, some in grouped(words % np.uint64(model["buckets"])):
        if k in model["stored"][1]:
            t = mapped(maps, model["path"], f"1-{k}", WORDS)
            i = np.minimum(np.searchsorted(t["key"], words[some]), len(t["key"]) - 1)
            hit = t["key"][i] == words[some]
            stat[some[hit]] = np.stack([wide(t, name, i[hit]) for name in ("follows", "n")], 1)
    total = max(model["follows"], 1)
    spread = sum(d * n for d, n in zip(model["d1"], model["few"], strict=True)) / total if model["follows"] else 1.0
    p = (np.maximum(stat[:, 0] - discount(stat[:, 0], model["d1"]), 0) / total + spread / (model["v"] + 1))[back]
    for size in range(2, model["order"] + 1):
        d = model["d"][size]
        count, c = looked_up(model, maps, size, context(columns[-size:-1]), right)
        gamma = np.where(c[:, 0] > 0, (c[:, 1] * d[0] + c[:, 2] * d[1] + c[:, 3] * d[2]) / np.maximum(c[:, 0], 1), 1.0)
        p = np.maximum(count - discount(count, d), 0) / np.maximum(c[:, 0], 1) + gamma * p
    return p, stat[back, 1]


def scorer(model: dict):
    def some(batch: pa.RecordBatch, maps: dict) -> pa.RecordBatch:
        token, place, size = tokens_of(batch)
        p, c = probabilities(model, maps, grams(token, place, model["order"]))
        at = np.cumsum(size) - size
        n = len(size)
        base = np.log10((c + 0.5) / (model["n"] + 0.5 * (model["v"] + 1)))
        add = lambda x: np.add.reduceat(x, at) if n else np.empty(0)
        arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(size.astype(np.int64)), pa.array(add((c > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(n, model["n"], np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict = {}
        for batch in cut_batches(stream, "text", 2_500_000):
            yield some(batch, maps)

    return batches


def score(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """Learns from the rows that aren't held out and scores all: log10 probabilities of whole texts.

    Null and empty texts are one end token. held_out: a boolean column; null counts as false.
    Repeated rows count as often as they stand there; other columns are dropped; an empty table
    gives no row. Perplexity is 10 ** (-score / n_tokens).
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = fit(texts.where("not held_out"), order)
    return texts.mapInArrow(scorer(model), RESULT)
