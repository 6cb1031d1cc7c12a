"""Harmonic packing of tokenised documents into sequences.

Lengths fall into reciprocal-capacity classes: class k holds the pieces of which k fit in one
sequence. A document is cut into pieces of exactly capacity // k (the largest class that it fills)
until a short tail is left, which goes uncut to the class of its length. Each class's sequences
take k pieces, whatever the pieces' sizes, so a piece's place follows from its number within its
class alone: tasks count their pieces, and a running sum over the tasks' counts numbers them.
What doesn't fill a last sequence of its class (under k pieces a class: a fixed number, whatever
the input) is strung together and cut at the capacity, its end into powers of two.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Numbered, Replay
from .common import released, table
from .words import cut_batches, joined_batches

TAIL = 64
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, task int, rank bigint, ids binary"
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_STATE: dict = {}
#: Words, and their letters, of which a worker remembers the ids.
MOST_WORDS, MOST_LETTERS = 600_000, 10_000_000


def byte_chars() -> list[str]:
    """The printable stand-in for each byte, as byte-level vocabularies write them."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def word_bpe(path: str) -> dict:
    """Tables of a lower-casing byte-level BPE with word ends, from a tokenizers file."""
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    chars = byte_chars()
    replay = Replay(pairs, [vocab[c] for c in chars], [vocab[c + suffix] for c in chars], {})
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    special = [x["content"] for x in spec["added_tokens"]]
    return {"replay": replay, "find": regex.compile(pattern).findall, "tokenizer": Tokenizer.from_file(path), "special": special, "chunks": regex.compile(r"\P{White_Space}+").findall}


def state(path: str) -> dict:
    if _STATE.get("path") != path:
        _STATE.clear()
        _STATE.update(word_bpe(path), path=path)
    if len(_STATE.get("words", ())) > MOST_WORDS or _STATE.get("letters", MOST_LETTERS + 1) > MOST_LETTERS:
        _STATE.update(words=Numbered(), ids=[], letters=0)
    return _STATE


def tokenise(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Each whole text's ids, as tokenizers gives them without special tokens.

    White space never reaches a token, so what stands between white space is encoded once: its
    words by merge replay, what isn't plain (a special token's string, a word that lower-casing
    might change by its neighbours) by the library itself.
    """
    s = state(path)
    words, ids = s["words"], s["ids"]
    number = words.__getitem__
    docs = []
    for t in texts:
        t = t or ""
        docs.append(list(map(number, t.split() if t.isascii() and not any(c in t for c in "\x1c\x1d\x1e\x1f") else s["chunks"](t))))
    fresh, parts, hard = Numbered(), [], []
    for i, w in enumerate(itertools.islice(words, len(ids), None), len(ids)):
        s["letters"] += len(w)
        if "<|" in w or "İ" in w or "Σ" in w:
            hard.append((i, w))
            parts.append(())
        else:
            parts.append([fresh[x] for x in s["find"]((w if w.isascii() else unicodedata.normalize("NFC", w)).lower())])
    flat, offs = s["replay"].replay([w.encode("utf-8") for w in fresh])
    flat, o = flat.astype("<u4").tobytes(), (4 * offs).tolist()
    of = [flat[x:y] for x, y in zip(o, o[1:], strict=False)]
    ids.extend(of[p[0]] if len(p) == 1 else b"".join([of[w] for w in p]) for p in parts)
    for i, w in hard:
        ids[i] = np.array(s["tokenizer"].encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    return [np.frombuffer(b"".join(map(ids.__getitem__, d)), "<u4") for d in docs]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n:
        k = -(-capacity // n) if n > TAIL else capacity // n
        size = capacity // k if n > TAIL else n
        out.append((size, k))
        n -= size
    return out


def piece_maker(tokens: Callable[[list], list[np.ndarray]], end_id: int, capacity: int):
    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        last: dict[int, list[tuple]] = {}
        for batch in cut_batches(joined_batches(stream, "text", 24_000_000), "text", 32_000_000):
            size = 0
            rows: list[list] = [[] for _ in range(7)]
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            ends = [size := size + len(t or "") for t in texts]
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 24_000_000)))
                for d, got in zip(doc_ids[a:b], tokens(texts[a:b]), strict=True):
                    n, start = len(got) + 1, 0
                    raw = np.append(got, np.uint32(end_id)).astype("<u4").tobytes()
                    for length, k in cuts(n, capacity):
                        ids = raw[4 * start : 4 * (start + length)]
                        rank = ranks[k] = ranks.get(k, -1) + 1
                        row = (d, start, length, zlib.crc32(ids), n, k, rank)
                        for column, x in zip(rows, row, strict=True):
                            column.append(x)
                        start += length
                        if k > 1:
                            kept = last.setdefault(k, [])
                            kept.append((*row, ids))
                            if len(kept) > 2 * k:
                                del kept[: -(k - 1)]
                a = b
            # a class's last k - 1 pieces of the task follow at the end, with their ids
            yield out(rows, task, None)
        kept = [x for k, rest in last.items() for x in rest[-(k - 1) :]]
        if kept:
            *rows, ids = map(list, zip(*kept, strict=True))
            yield out(rows, task, ids)

    def out(rows, task, ids):
        n = len(rows[0])
        types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
        doc, start, length, crc, total, k, rank = (pa.array(x, t) for x, t in zip(rows, types, strict=True))
        arrays = [doc, start, length, crc, total, k, pa.array(np.full(n, task, np.int32)), rank, pa.array(ids or [None] * n, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "rank", "ids"])

    return batches


def string_rest(capacity: int):
    """Strings the pieces that fill no sequence of their class; their number doesn't grow with the input."""

    def pack(pdf):
        pdf = pdf.sort_values(["class", "number"])
        base = int(pdf["base"].iloc[0]) if len(pdf) else 0
        total = int(pdf["length"].sum())
        bounds = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
        out, seq, used = [], 0, 0
        for r in pdf.itertuples():
            done = 0
            while done < r.length:
                size = min(r.length - done, bounds[seq] - used)
                ids = bytes(r.ids[4 * done : 4 * (done + size)])
                out.append((r.doc_id, r.start + done, size, zlib.crc32(ids), r.doc_tokens, base + seq, used))
                done, used = done + size, used + size
                if used == bounds[seq]:
                    seq, used = seq + 1, 0
        import pandas as pd

        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pack


def pack(docs: DataFrame, tokens: Callable[[list], list[np.ndarray]], end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """One row a piece: where it lies in its document and in which sequence, from which offset.

    tokens: texts -> arrays of ids, run on the workers. Null and empty texts are the end id
    alone. A sequence is what shares a sequence_id; ids of sequences run from 0. Repeated rows
    are packed each; other columns are dropped; an empty table gives no row.
    """
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = table(pieces.mapInArrow(piece_maker(tokens, end_id, capacity), PIECES), "pieces")
    counts = pieces.where("ids is null").groupBy("class", "task").agg(F.count("*").alias("n"))
    # one row for each task of a class: a window over tasks, not over pieces
    before = F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = table(counts.select("class", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    classes = counts.groupBy("class").agg(F.sum("n").alias("n")).withColumn("bins", F.floor(F.col("n") / F.col("class")))
    base = F.coalesce(F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("class", "bins", base.alias("base"), F.sum("bins").over(Window.partitionBy(F.lit(1))).alias("all_bins"))
    places = counts.select("class", "task", "before").join(classes, "class")
    placed = pieces.join(places, ["class", "task"]).withColumn("number", F.col("before") + F.col("rank"))
    inside = placed.where("ids is null and number < bins * class")
    # within a class all pieces but a tail's have one size; a tail's offset is the sum of those before it in its sequence
    flat = inside.where(F.lit(capacity) / F.col("class") >= F.lit(TAIL + 1))
    flat = flat.withColumn("offset", F.pmod("number", F.col("class")) * F.col("length"))
    w = Window.partitionBy("class", "sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    sequence = (F.col("base") + F.floor(F.col("number") / F.col("class"))).cast("bigint").alias("sequence_id")
    mixed = inside.where(F.lit(capacity) / F.col("class") < F.lit(TAIL + 1)).select("*", sequence).withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = flat.select(*cols, sequence, F.col("offset").cast("bigint").alias("offset")).unionByName(mixed.select(*cols, "sequence_id", F.col("offset").cast("bigint").alias("offset")))
    rest = placed.where("ids is not null and number >= bins * class")
    rest = rest.select(*cols, "class", "number", F.col("all_bins").alias("base"), "ids").groupBy("base").applyInPandas(string_rest(capacity), PLACED)
    return full.unionByName(rest)
