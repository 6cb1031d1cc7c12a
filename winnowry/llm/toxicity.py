"""Toxicity by a subsequence string-kernel SVM on words, with Nyström landmarks.

The kernel of two words sums, over their common subsequences of three letters, a decay for each
letter that a subsequence spans in either word; subsequences spanning more than SPAN letters don't
count. So an insult with letters or signs put between its own still resembles it. An SVM is
trained on the kernel's Nyström features at some landmark words. A linear machine on those
features is a sum of kernels, hence linear in the subsequences as well: scoring looks up each
subsequence's weight in a table. Labels belong to texts, so the words that make a text toxic are
chosen in turns: train, take each toxic text's highest words as positive and the highest words of
the others as negative, train again.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .words import cut_batches

DECAY, SPAN, MOST = 0.75, 8, 24
#: Rows of each label that training takes, those of least hash: what is gathered stays bounded.
SAMPLE = {1: 1000, 0: 1500}
LETTERS = 48
RESULT = "doc_id bigint, held_out boolean, score double, predicted int"
STEPS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
SPACED = re.compile(r"(?<!\S)(?:\w\s){2,}\w(?!\S)")
#: a-z, then letters of other alphabets and signs by hash
CODES = np.array([c - 96 if 97 <= c <= 122 else 0 for c in range(128)], np.int64)


def words_of(text: str) -> set[str]:
    """Lower-cased words between white space, those with signs also without them; single letters in a row are one word as well."""
    text = text.lower()
    words = set(text.split())
    words.update([re.sub(r"\s", "", m) for m in SPACED.findall(text)])
    words.update([re.sub(r"[\W_]", "", w) for w in words if not w.isalpha()])
    words.discard("")
    return words


def stretched(word: str, rng) -> str:
    """The word with another letter put somewhere inside."""
    i = int(rng.integers(1, max(2, len(word))))
    return word[:i] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[i:]


def coded(words: list[str]) -> np.ndarray:
    """Letter codes of words, 0 behind their ends; a longer word is cut into overlapping pieces by the caller."""
    n = len(words)
    points = np.frombuffer("".join(w.ljust(MOST, "\0")[:MOST] for w in words).encode("utf-32-le"), np.uint32).reshape(n, MOST).astype(np.int64)
    codes = np.where(points < 128, CODES[np.minimum(points, 127)], 27 + points % 13)
    signs = (points > 0) & (points < 128) & (codes == 0)
    return np.where(signs, 40 + points % 8, codes)


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word rows, subsequence numbers, weight) for each gap pattern."""
    for i, j in STEPS:
        a, b, c = codes[:, : MOST - j], codes[:, i : MOST - j + i], codes[:, j:]
        row, at = np.nonzero(c)
        yield row, (a[row, at] * LETTERS + b[row, at]) * LETTERS + c[row, at], DECAY ** (j + 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, value) of unit-length explicit features, sorted by row."""
    parts = [(row, sub, np.full(len(row), w)) for row, sub, w in subsequences(coded(words))]
    row, sub, val = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = row * LETTERS**3 + sub
    keys, back = np.unique(key, return_inverse=True)
    val = np.bincount(back, val, len(keys))
    row, sub = keys // LETTERS**3, keys % LETTERS**3
    norm = np.sqrt(np.bincount(row, val * val, len(words)))
    return row, sub, val / norm[row]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(landmarks)))
    lr, ls, lv = features(landmarks)
    table = np.zeros((LETTERS**3, len(landmarks)), np.float32)
    table[ls, lr] = lv
    for a in range(0, len(words), 500):
        row, sub, val = features(words[a : a + 500])
        for k in range(len(landmarks)):
            out[a : a + 500, k] = np.bincount(row, val * table[sub, k], min(500, len(words) - a))
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with hinge loss by dual coordinate descent; y is 1 or -1. The last column of x is the bias."""
    rng = np.random.default_rng(7)
    x = np.hstack([x, np.ones((len(x), 1))])
    q, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= MOST else [word[i : i + MOST] for i in range(0, len(word) - MOST // 2, MOST // 2)]


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Each word's distance from the SVM's plane; of long words the highest of their pieces'."""
    out = np.full(len(words), -9.0)
    for a in range(0, len(words), 2000):
        some, owner = [], []
        for i, w in enumerate(words[a : a + 2000], a):
            for p in pieces(w):
                some.append(p)
                owner.append(i)
        codes = coded(some)
        dot, low = np.zeros(len(some)), np.zeros(len(some))
        for row, sub, w in subsequences(codes):
            dot += np.bincount(row, model["table"][sub], len(some)) * w
            low += np.bincount(row, minlength=len(some)) * (w * w)
        # a word's length is at least that of distinct subsequences: most words are decided by this alone
        value = np.where(low > 0, dot / np.sqrt(np.maximum(low, 1e-12)), 0.0)
        near = np.flatnonzero(value + model["bias"] > model["cut"] - 1)
        if len(near):
            row, sub, val = features([some[i] for i in near])
            value[near] = np.bincount(row, val * model["table"][sub], len(near))
        np.maximum.at(out, np.array(owner), value + model["bias"])
    return out


def train(bags: list[set[str]], labels: list[int], landmarks: int = 96, rounds: int = 3) -> dict:
    """The model from labelled texts, each as its set of words. Without texts of both labels, a machine that calls nothing toxic."""
    empty = {"table": np.zeros(LETTERS**3, np.float32), "bias": -1.0, "cut": 0.0, "scale": 4.0}
    good, bad = Counter(), Counter()
    for bag, label in zip(bags, labels, strict=True):
        (bad if label else good).update(bag)
    n_bad, n_good = sum(map(bool, labels)), len(labels) - sum(map(bool, labels))
    if not n_bad or not n_good:
        return empty
    odds = {w: (c + 0.1) / (n_bad + 1) / ((good[w] + 0.1) / (n_good + 1)) * math.log1p(c) for w, c in bad.items()}
    toxic = [b for b, label in zip(bags, labels, strict=True) if label and b]
    rng = np.random.default_rng(7)
    common = sorted(good)
    positive = Counter(max(b, key=lambda w: (odds[w], w)) for b in toxic)
    negative = set(rng.choice(common, min(4000, len(common)), replace=False)) if common else set()
    model = empty
    for _ in range(rounds):
        pos = [w for w, c in positive.most_common() if w not in good][:600]
        neg = sorted(w for w in negative if w not in positive)
        if not pos or not neg:
            return empty
        wide = [x for w in pos[:150] for x in {stretched(w, rng) for _ in range(3)} if x not in good]
        words = [pieces(w)[0] for w in pos + wide + neg]
        y = np.array([1.0] * (len(pos) + len(wide)) + [-1.0] * len(neg))
        marks = list(dict.fromkeys([*(pieces(w)[0] for w in pos[: landmarks * 2 // 3]), *(pieces(w)[0] for w in rng.permutation(neg)[: landmarks // 3])]))
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        fit = values > 1e-6
        root = vectors[:, fit] / np.sqrt(values[fit])
        x = kernel(words, marks) @ root
        weight = np.array([positive[w] for w in pos] + [1.0] * len(wide + neg))
        w, bias = svm(x, y, 5.0 * np.minimum(weight, 20.0))
        table = np.zeros(LETTERS**3, np.float64)
        row, sub, val = features(marks)
        np.add.at(table, sub, val * (root @ w)[row])
        model = {"table": table.astype(np.float32), "bias": bias, "cut": 0.0, "scale": 4.0}
        everything = sorted(set().union(*bags))
        of = dict(zip(everything, word_scores(everything, model).tolist(), strict=True))
        positive = Counter()
        for b in toxic:
            top = max(b, key=lambda w: (of[w], w))
            positive.update([top, *(x for x in b if of[x] > 0 and x not in good and x != top)])
        negative |= {x for x in common if of[x] > -0.8}
    tops = np.array([max((of[x] for x in b), default=-2.0) for b in bags])
    hit, miss = np.sort(tops[np.array(labels) == 1]), np.sort(tops[np.array(labels) == 0])
    # the cut with the fewest errors on the training texts, the middle one of equally good ones
    cuts = np.unique(np.concatenate([hit, miss]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    errors = np.searchsorted(hit, cuts) / len(hit) + (len(miss) - np.searchsorted(miss, cuts)) / len(miss)
    best = cuts[errors <= errors.min() + 1e-12]
    return model | {"cut": float(best[np.argmin(abs(best - (best[0] + best[-1]) / 2))])}


#: Words, and their letters, whose scores a task remembers.
MOST_SEEN, MOST_LETTERS = 200_000, 8_000_000


def scores_of(model: dict):
    """A function from texts to scores. It remembers words' scores within bounds."""
    seen: dict[str, float] = {}
    letters = 0

    def scores(texts: list[str | None]) -> np.ndarray:
        nonlocal letters
        bags = [words_of(t or "") for t in texts]
        fresh = list(set().union(*bags).difference(seen))
        seen.update(zip(fresh, word_scores(fresh, model).tolist(), strict=True))
        margin = np.array([max(map(seen.__getitem__, bag), default=-9.0) for bag in bags]) - model["cut"]
        letters += sum(map(len, fresh))
        if len(seen) > MOST_SEEN or letters > MOST_LETTERS:
            seen.clear()
            letters = 0
        return 1 / (1 + np.exp(-np.clip(model["scale"] * margin, -30, 30)))

    return scores


def scorer(model: dict):
    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(model)
        for batch in cut_batches(stream, "text", 2_000_000):
            score = scores(batch.column("text").to_pylist())
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    return batches


def fit(docs: DataFrame, labels: DataFrame, held_out=None) -> dict:
    """The model from at most SAMPLE labelled rows of each label, those of least hash(doc_id), not held out."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if held_out is not None:
        rows = rows.where(~held_out)
    chosen = None
    for label, most in SAMPLE.items():
        part = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most sum(SAMPLE) pairs of a number and a label; of the texts the driver keeps one copy of each word
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.distinct()), "doc_id").orderBy("doc_id", "toxic", "text")
    got = [(set(map(sys.intern, words_of(r.text or ""))), r.toxic) for r in chosen.toLocalIterator()]
    return train([bag for bag, _ in got], [label for _, label in got])


def fold(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)), F.lit(-1)) == 0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every whole text's toxicity, learnt from the labelled rows outside the held-out fold.

    A text's score is that of its worst word; null and empty texts score next to 0. A doc_id
    with both labels trains as both. Repeated rows are scored each; other columns are dropped.
    """
    model = fit(docs, labels, fold())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fold().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scorer(model), RESULT)


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """The rows, with all their columns, whose text the model doesn't call toxic; null and empty texts stay."""
    @released
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(model)
        for batch in cut_batches(stream, "text", 2_000_000):
            yield batch.filter(pa.array(scores(batch.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(batches, docs.schema)
