"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .words import joined_batches

NONE = np.int32(2**31 - 1)
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Replay:
    """Encodes many distinct words at once: an inverted index from token pair to positions,
    from which every merge is taken in rank order over all words together.

    pairs: (left id, right id) -> (rank, merged id). start: the 256 bytes' ids within a word;
    end: the same for a word's last byte. whole: words that are one token without any merge.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], start: list[int], end: list[int], whole: dict[bytes, int]):
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.uint64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter((r for r, _ in pairs.values()), np.int32, len(pairs))[order]
        self.ids_of = np.full(int(self.ranks.max(initial=0)) + 1, -1, np.int32)
        for r, i in pairs.values():
            self.ids_of[r] = i
        self.start, self.end, self.whole, self.pairs = np.array(start, np.int32), np.array(end, np.int32), whole, pairs

    @classmethod
    def from_ranks(cls, path: str) -> Replay:
        """A .tiktoken file: two tokens merge if their bytes together are a token; its rank is its id."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a, b] = (r, r)
        single = [ranks[bytes([i])] for i in range(256)]
        new = cls(pairs, single, single, ranks)
        new.tokens = {r: t for t, r in ranks.items()}
        return new

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """One word by repeated search for the lowest rank: what replay() has to equal."""
        if word in self.whole:
            return [self.whole[word]]
        ids = [*self.start[list(word[:-1])].tolist(), int(self.end[word[-1]])] if word else []
        while len(ids) > 1:
            (rank, new), i = min((self.pairs.get((ids[i], ids[i + 1]), (NONE, 0)), i) for i in range(len(ids) - 1))
            if rank == NONE:
                break
            ids[i : i + 2] = [new]
        return ids

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the words' tokens, one word after the other."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        full = lens > 0
        ids = self.start[raw]
        ids[ends[full] - 1] = self.end[raw[ends[full] - 1]]
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        alive = np.ones(n, bool)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends[full] - 1] = -1
        prv[(ends - lens)[full]] = -1
        rank = np.full(n, NONE, np.int32)
        if n > 1:
            rank[:-1] = self.pair(ids[:-1], ids[1:])
        rank[nxt < 0] = NONE
        if self.whole:
            whole = np.fromiter((self.whole.get(w, -1) for w in words), np.int32, len(words))
            done = (whole >= 0) & full
            at = done[word_of]
            rank[at] = NONE
            alive[at] = False
            first = (ends - lens)[done]
            alive[first] = True
            ids[first] = whole[done]
        mark = np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enters positions in the inverted index under the rank of their pair."""
            at = at[rank[at] != NONE]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            r, at = r[order], at[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            start = [0, *cut.tolist()]
            for a, b, k in zip(start, [*start[1:], len(at)], r[start].tolist(), strict=True):
                if k in index:
                    index[k].append(at[a:b])
                else:
                    index[k] = [at[a:b]]
                    heapq.heappush(heap, k)

        add(np.flatnonzero(rank != NONE).astype(np.int32))
        redo: set[int] = set()
        while heap:
            k = heapq.heappop(heap)
            parts = index.pop(k)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[alive[at] & (rank[at] == k)]
            if not len(at):
                continue
            if len(parts) > 1:
                at.sort()
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            mark[at] = True
            over = mark[nxt[at]].any()
            mark[at] = False
            if over:  # overlapping pairs of one rank: leftmost first
                keep, gone = [], set()
                for p in at.tolist():
                    if p not in gone:
                        keep.append(p)
                        gone.add(int(nxt[p]))
                at = np.array(keep, np.int32)
            right = nxt[at]
            after = nxt[right]
            before = prv[at]
            ids[at] = self.ids_of[k]
            alive[right] = False
            rank[right] = NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            rank[at] = NONE
            # neighbours: the pair that starts here and the pair before it
            a = at[has]
            a = a[nxt[a] >= 0]
            rank[a] = self.pair(ids[a], ids[nxt[a]])
            b = before[before >= 0]
            b = b[alive[b]]
            rank[b] = self.pair(ids[b], ids[nxt[b]])
            new = np.concatenate([a, b])
            low = new[rank[new] < k]
            if len(low):  # a lower rank appeared: its word is redone in the plain order
                redo.update(word_of[low].tolist())
            add(new)
        counts = np.bincount(word_of[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)
        out, offs = ids[alive], np.concatenate([[0], np.cumsum(counts)])
        if redo:
            lists = np.split(out, offs[1:-1])
            for w in redo:
                lists[w] = np.array(self.one(words[w]), np.int32)
            offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
            out = np.concatenate(lists)
        return out, offs


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_STATE: dict = {}
#: Pieces, and their letters, of which a worker remembers the ids.
MOST_PIECES, MOST_LETTERS = 300_000, 8_000_000
#: A run of white space in which a blank or a line feed isn't the first: such texts aren't cut at white space.
RUN = re.compile(r"\s[ \n]")


def state(path: str, pattern: str, digest: bool) -> dict:
    """The worker's tables for one vocabulary; they last as long as the worker, within bounds."""
    import regex

    if _STATE.get("of") != (path, pattern, digest):
        _STATE.clear()
        _STATE.update(of=(path, pattern, digest), replay=Replay.from_ranks(path), find=regex.compile(pattern).findall)
    if len(_STATE.get("pieces", ())) > MOST_PIECES or _STATE.get("letters", MOST_LETTERS + 1) > MOST_LETTERS:
        _STATE.update(pieces=Numbered(), ids=[], dec=[], n=[], letters=0)
    return _STATE


def pieces_of(text: str, find) -> list[str]:
    """The text cut before each blank and line feed; a blank that begins a piece isn't written.

    The pattern's matches never hold white space but at their start, and those of one piece don't
    depend on the next one. A text with longer runs of white space is cut at the matches
    themselves, each marked by a first NUL.
    """
    if RUN.search(text) or "\0" in text:
        return ["\0" + x for x in find(text)]
    first, *rest = text.replace("\n", " \n").split(" ")
    return [("\0" + x) for x in find(first)] + rest


def encoder(path: str, pattern: str, digest: bool, chunk: int = 16_000_000):
    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined_batches(stream, "text", chunk // 2):
            texts = batch.column("text")
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + chunk)))
                yield some(batch.column("doc_id").slice(a, b - a), texts.slice(a, b - a))
                a = b

    def some(doc_ids, texts) -> pa.RecordBatch:
        s = state(path, pattern, digest)
        pieces, find, ids, dec, n = s["pieces"], s["find"], s["ids"], s["dec"], s["n"]
        number = pieces.__getitem__
        docs = [list(map(number, pieces_of(t, find))) if t else [] for t in texts.to_pylist()]
        if len(pieces) > len(n):
            words, parts = Numbered(), []
            for x in itertools.islice(pieces, len(n), None):
                s["letters"] += len(x)
                parts.append([words[x[1:]]] if x[:1] == "\0" else [words[w] for w in find(x if x[:1] == "\n" else " " + x)])
            flat, offs = s["replay"].replay([w.encode("utf-8") for w in words])
            flat, o = flat.tolist(), offs.tolist()
            of = [flat[x:y] for x, y in zip(o, o[1:], strict=False)]
            token = s["replay"].tokens.__getitem__
            for p in parts:
                got = of[p[0]] if len(p) == 1 else [i for w in p for i in of[w]]
                n.append(len(got))
                if digest:
                    ids.append(",".join(map(str, got)))
                    dec.append(b"".join(map(token, got)))
                else:
                    ids.append(got)
        if not digest:
            rows = [[x for w in d for x in ids[w]] for d in docs]
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])
        shas, decs = [], []
        for d in docs:
            shas.append(hashlib.sha256(",".join(map(ids.__getitem__, d)).encode()).hexdigest())
            decs.append(hashlib.sha256(b"".join(map(dec.__getitem__, d))).hexdigest())
        counts = [sum(map(n.__getitem__, d)) for d in docs]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(shas), pa.array(decs)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return batches


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null or empty text: no ids.

    Rows are independent, so repeated rows give repeated results; other columns are dropped.
    """
    return docs.select("doc_id", "text").mapInArrow(encoder(path, pattern, False), "doc_id bigint, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids): the tokens' bytes one after the other; null ids: none."""

    def batches(stream):
        with open(path, "rb") as f:
            token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        for batch in stream:
            rows = [b"".join(token[i] for i in x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(batches, "doc_id bigint, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: the number of ids, and digests of the ids and of what they decode to.

    Null and empty texts have no ids and the digests of the empty string.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encoder(path, pattern, True), RESULT)
