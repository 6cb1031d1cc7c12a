"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import components, gram_hashes, mix64, released, sieved, table
from .words import cut_batches, hashes

REGISTERS, BANDS, ROWS, BLOCK = 126, 21, 6, 1024


def weighted_shingles(offsets: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles, sorted by document and shingle."""
    grams = [gram_hashes(words[a:b], k) for a, b in zip(offsets, offsets[1:], strict=False)]
    doc = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    gram = np.concatenate([np.sort(g) for g in grams]) if grams else np.empty(0, np.uint64)
    if not len(gram):
        return doc, gram, np.empty(0)
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], gram[at], np.diff(np.append(at, len(gram))).astype(np.float64)


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The item that arrives first at each register: an n x registers array of item hashes.

    Each item sends arrivals of a Poisson process with its weight as rate, each to a random
    register. An item is dropped as soon as its next arrival is later than all its document's
    registers have: nothing after that can change them. The share of registers in which two
    documents agree estimates their probability Jaccard similarity.
    """
    time = np.full(n * registers, np.inf)
    first = np.zeros(n * registers, np.uint64)
    at = np.zeros(len(item))
    step = 0
    with np.errstate(over="ignore"):
        while len(item):
            r = mix64(item + np.uint64((step * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            slot = doc * registers + (mix64(r + np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
            better = np.flatnonzero(at < time[slot])
            s, t = slot[better], at[better]
            np.minimum.at(time, s, t)
            win = t == time[s]
            first[s[win]] = item[better[win]]
            alive = at < time.reshape(n, registers).max(1)[doc]
            doc, item, weight, at = doc[alive], item[alive], weight[alive], at[alive]
            step += 1
    return first.reshape(n, registers)


def signer(k: int):
    """For each text hashes of its words in order (null without words), band keys and signature."""

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, words = hashes(batch.column("text"))
        n = len(batch)
        first = prob_minhash(*weighted_shingles(offsets, words, k), n)
        keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], n, 0)
        with np.errstate(over="ignore"):
            for j in range(ROWS):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + first[:, j::ROWS])
        signature = (mix64(first) & np.uint64(0xFFFFFFFF)).astype("<u4")
        bands = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(keys.view(np.int64).ravel()))
        blank = np.diff(offsets) == 0
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]), "<i8").reshape(n, 2)
        arrays = [batch.column("doc_id"), batch.column("mark"), batch.column("node"), *(pa.array(both[:, i], mask=blank) for i in (0, 1)), bands, pa.array([r.tobytes() for r in signature], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "node", "k1", "k2", "bands", "signature"])

    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(stream, "text", 3_000_000, 2000):
            yield some(batch)

    return batches


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sorted weighted shingle sets; Jaccard similarity where all weights are equal."""
    (x, u), (y, v) = a, b
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    if not hit.any():
        return 0.0
    cu, cv = u[hit], v[at[hit]]
    only_x, only_y = u.sum() - cu.sum(), v.sum() - cv.sum()
    total = 0.0
    for p, q in {*zip(cu.tolist(), cv.tolist(), strict=True)}:
        same = np.count_nonzero((cu == p) & (cv == q))
        total += same / (np.maximum(cu / p, cv / q).sum() + only_x / p + only_y / q)
    return total


#: Slots, a power of two, of a table of one text's shingles.
SLOTS = 1 << 20


def at_most(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    """No less than the similarity() of a weighted shingle set to each of others, and equal or close to it where weights are ones.

    A shingle that both have counts one to the sum of all greater weights, if its weight is 1 in
    both, and else at most its lesser share of a set. table: SLOTS zeros, left so; shingles that
    clash there only raise the bound.
    """
    x, u = one
    own = (x & np.uint64(SLOTS - 1)).astype(np.int64)
    np.maximum.at(table, own, u)
    size = np.array([len(y) for y, _ in others])
    start = np.cumsum(size) - size
    v = np.concatenate([w for _, w in others])
    w = table[(np.concatenate([y for y, _ in others]) & np.uint64(SLOTS - 1)).astype(np.int64)]
    table[own] = 0
    shared = np.minimum(w, v)
    ones = (w == 1) & (v == 1)
    total_x, total_y = u.sum(), np.add.reduceat(v, start)
    most = np.add.reduceat(ones, start, dtype=np.float64) / (total_x + total_y - np.add.reduceat(shared, start))
    rest = np.flatnonzero((shared > 0) & ~ones)
    of = np.searchsorted(start, rest, side="right") - 1
    return most + np.bincount(of, np.minimum(w[rest] / total_x, v[rest] / total_y[of]), len(others))


def fewest(least: float) -> float:
    """Registers that agree in a pair at the bound, but for one of 100,000 pairs: 4.5 standard deviations below the mean."""
    return REGISTERS * (least - 4.5 * (least * (1 - least) / REGISTERS) ** 0.5)


def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a pair of blocks on the left and on the right, and whether both are the same block."""
    side = np.asarray(t.column("side"))
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0), bool(side[0] == 2)


def signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u4").reshape(-1, REGISTERS)


def links(u: list[int], v: list[int]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]) if u else None


def candidates(least: float):
    """Within a pair of blocks of a bucket, links between texts whose signatures agree enough; as many as connect those that any such pair connects."""
    matches = fewest(least)

    def work(t: pa.Table):
        rep, sign = np.asarray(t.column("rep")), signatures(t)
        left, right, _ = sides(t)
        label = np.arange(len(rep))
        u, v = [], []
        for i in left.tolist():
            others = right[label[right] != label[i]]
            if len(others):
                hit = others[np.count_nonzero(sign[others] == sign[i], axis=1) >= matches]
                at = np.unique(label[hit], return_index=True)[1]
                for j in hit[at].tolist():
                    u.append(int(rep[i]))
                    v.append(int(rep[j]))
                    label[label == label[j]] = label[i]
        return links(u, v)

    return work


def verifier(k: int, least: float):
    """Within a pair of blocks of a component, links between texts of enough similarity; as many as connect those that any such pair connects."""
    matches = fewest(least)
    tables: list[np.ndarray] = []

    def work(t: pa.Table):
        rep, sign = np.asarray(t.column("rep")), signatures(t)
        n = len(rep)
        left, right, alone = sides(t)
        found = []
        theirs = np.ascontiguousarray(sign[right].T)
        for i in left.tolist():
            agree = np.zeros(len(right), np.int16)
            for r in range(REGISTERS):
                agree += theirs[r] == sign[i, r]
            j = np.flatnonzero(agree >= matches)
            other = right[j]
            ok = other > i if alone else np.ones(len(j), bool)
            found.append(np.stack([np.full(ok.sum(), i), other[ok], agree[j[ok]]], 1))
        pairs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
        pairs = pairs[np.argsort(-pairs[:, 2], kind="stable")]
        texts = t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")
        sets: dict[int, tuple] = {}

        def grams(i: int):
            if i not in sets:
                _, g, w = weighted_shingles(*hashes(texts.slice(i, 1)), k)
                sets[i] = (g, w)
            return sets[i]

        def possible(some: np.ndarray) -> np.ndarray:
            """Which pairs may be similar enough: in a large component most are not, and end here, a text's pairs at once."""
            if not tables:
                tables.append(np.zeros(SLOTS))
            most = np.empty(len(some))
            order = np.argsort(some[:, 0], kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(some[order, 0])) + 1):
                of = [grams(j) for j in some[own, 1].tolist()]
                so_far = np.cumsum([len(g) for g, _ in of])
                a = 0
                while a < len(of):
                    b = max(a + 1, int(np.searchsorted(so_far, (so_far[a - 1] if a else 0) + SLOTS, side="right")))
                    most[own[a:b]] = at_most(grams(int(some[own[0], 0])), of[a:b], tables[0])
                    a = b
            return most >= least - 1e-9

        union, u, v = blocks.Union(n), [], []
        a, size = 0, 4096
        while a < len(pairs):  # alike pairs of one component need no check: their link changes nothing
            some = pairs[a : a + size]
            a, size = a + size, min(4 * size, 1 << 17)
            root = np.array([union.root(i) for i in range(n)])
            some = some[root[some[:, 0]] != root[some[:, 1]]]
            for i, j, _ in (some[possible(some)] if len(some) > 50 else some).tolist():
                if union.root(i) != union.root(j) and similarity(grams(i), grams(j)) >= least:
                    union.join(i, j)
                    u.append(int(rep[i]))
                    v.append(int(rep[j]))
        return links(u, v)

    return work


def classes(docs: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """dedup()'s rows and mark, a hash of the row's text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    known = rows.where("doc_id is not null")
    shared = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    # a number for each row that compares like it: its own, or a hash where rows share theirs
    known = known.withColumn("node", F.xxhash64("doc_id", "text") if shared else F.col("doc_id"))
    signed = table(known.select("doc_id", "mark", "node", "text").mapInArrow(signer(k), "doc_id bigint, mark bigint, node bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary"), "signatures")
    reps = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("node", "mark", "bands", "signature")).alias("r"))
    reps = table(reps.select("k1", "k2", F.col("r.node").alias("rep"), "r.mark", "r.bands", "r.signature"), "texts")
    # texts that share a band's bucket meet there by their signatures: chance hits end here
    bands = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    met = blocks.spread(bands, ["band", "key"], "rep", BLOCK).join(reps.select("rep", "signature"), "rep")
    near = components(blocks.each(met, ["band", "key"], candidates(least), "u bigint, v bigint"))
    members = table(reps.select("rep", "signature").join(near, F.col("rep") == F.col("node")).select("rep", "signature", "component"), "members")
    possible, _ = sieved(known.select("node", "text"), F.xxhash64("node"), members, F.xxhash64("rep"))
    texts = possible.join(members, F.col("node") == F.col("rep")).select("rep", "component", "signature", "text")
    spread = blocks.spread(texts.dropDuplicates(["rep"]) if shared else texts, ["component"], "rep", BLOCK)
    found = components(blocks.each(spread, ["component"], verifier(k, least), "u bigint, v bigint"))
    of_text = reps.select("k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_id"))
    out = signed.select("doc_id", "mark", "k1", "k2").join(of_text, ["k1", "k2"], "left")
    others = rows.where("doc_id is null").select("doc_id", "mark", "doc_id", F.lit(True)).toDF("doc_id", "mark", "class_id", "kept")
    if shared:
        first = out.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
        out = out.join(first, "class_id", "left")
        kept = F.col("first").isNull() | (F.struct("doc_id", "mark") == F.col("first"))
        return out.select("doc_id", "mark", F.coalesce("first.doc_id", "doc_id").alias("class_id"), kept.alias("kept")).unionByName(others)
    return out.select("doc_id", "mark", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")).unionByName(others)


def dedup(docs: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """(doc_id, class_id, kept): documents linked by a similarity of at least least, over any number of steps.

    class_id is the class's smallest doc_id, kept its one row to keep. Documents with the same
    words are one text from the start. Texts without words (null, empty, blank) are alike to none
    and stay; so do rows without doc_id, whose class is null. Rows that share a doc_id are
    compared each; of those with a class's smallest doc_id the one of smallest text hash is kept,
    all of them where they are the same. Other columns are dropped; an empty table gives no row.
    """
    return classes(docs, least, k).drop("mark")
