"""Repeated paragraphs of a page: exact by window, near and contained ones by a greedy scan in page order."""

from __future__ import annotations

import functools
import operator
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowry.functions.text import one_line

KEY = ("page_id", "variant")
#: Letters of a piece that two like texts must share: the shortest that any text is cut into.
GRAM = 5
#: Letters of a page's texts that are searched one by one; beyond them an index of their runs is kept.
SEARCHED = 10_000


def normalized(c):
    """Lower-cased text with plain quotes and single blanks."""
    marks = "‘’“”�"
    one = one_line(c)
    # translate takes a text apart into its letters
    some = functools.reduce(operator.or_, (c.contains(m) for m in marks))
    return F.lower(F.when(some, F.translate(one, marks, "''\"\"")).otherwise(one))


def eligible():
    """Kept, not verbatim, long enough and not mostly punctuation."""
    norm = F.col("norm")
    signs = F.regexp_count(norm, F.lit("[^\\p{L}\\p{N}_\\s]"))
    return (F.col("class_type") == "good") & ~F.col("verbatim") & (F.char_length(norm) >= 12) & (signs <= 0.13 * F.char_length(norm))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Adds duplicate: an earlier kept paragraph of the page has the same normalized text."""
    rows = rows.withColumn("norm", normalized(F.col("text"))).withColumn("_e", eligible())
    w = Window.partitionBy(*KEY, "_e", "norm").orderBy("idx")
    return rows.withColumn("duplicate", F.col("_e") & (F.row_number().over(w) > 1)).drop("_e")


def duplicate_counts(rows: DataFrame) -> DataFrame:
    """(page_id, variant, n): how many eligible paragraphs repeat an earlier one's normalized text, without a window: what a group of equal ones has beyond its first."""
    # an inlined struct is computed once; a column would be written out again in every use
    some = rows.select(*KEY, "class_type", "verbatim", F.inline(F.array(F.struct(normalized(F.col("text")).alias("norm")))))
    some = some.where(eligible()).groupBy(*KEY, F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2")).agg((F.count("*") - 1).alias("n"))
    return some.where("n > 0").groupBy(*KEY).agg(F.sum("n").alias("n"))


def lcs(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(a):
        masks[ch] |= 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(short: str, long: str) -> float:
    """The best ratio of the shorter text with a stretch of its length of the longer one, or of its ends."""
    if len(short) > len(long):
        short, long = long, short
    if not short or short in long:
        return 100.0
    n, best = len(short), 0.0
    letters = set(short)
    for i in range(1 - n, len(long)):
        a, b = max(0, i), min(len(long), i + n)
        if long[b - 1] in letters or long[a] in letters:
            best = max(best, ratio(short, long[a:b])) if b - a >= n // 2 else best
    return best


def holds_nearly(new: str, old: str, least: float = 98.0) -> bool:
    """partial_ratio(new, old) >= least for a new text shorter than the old one.

    A stretch has in common at most what an earlier one has and the letters that came since, so
    those that can't reach the ratio are passed by without a comparison.
    """
    if not new or new in old:
        return True
    n, m, letters = len(new), len(old), set(new)
    common, end = 0, 0
    for i in range(1 - n, m):
        a, b = max(0, i), min(m, i + n)
        if b - a < n // 2 or (old[b - 1] not in letters and old[a] not in letters):
            continue
        most = min(common + b - end, b - a)
        if 200.0 * most / (n + b - a) < least:
            continue
        common, end = lcs(new, old[a:b]), b
        if 200.0 * common / (n + b - a) >= least:
            return True
    return False


def same(new: str, old: str) -> bool:
    if new == old:
        return True
    if 2 * min(len(new), len(old)) >= 0.97 * (len(new) + len(old)) and ratio(new, old) >= 97:
        return True
    return 40 <= len(new) < len(old) and holds_nearly(new, old)


def cut_pieces(new: str) -> list[str]:
    """The text in so many pieces that one of them stands unchanged in every text that same() accepts.

    Texts of 97 % differ by at most 0.03 times both lengths, the longer one's at most 1.0619 times
    the shorter one's: fewer insertions and deletions than pieces. A text that is nearly held by a
    longer one differs by less.
    """
    n = len(new)
    k = int(0.065 * n) + 2
    return [new[i * n // k : (i + 1) * n // k] for i in range(k)]


def may_be_same(new: str, old: str, pieces: list[str]) -> bool:
    """Whether enough of the new text's pieces stand in the old one for same(): each insertion or deletion spoils one piece at most."""
    n, m = len(new), len(old)
    least = len(pieces)
    if 2 * min(n, m) >= 0.97 * (n + m):
        least = len(pieces) - 1 - int(0.03 * (n + m))
    if 40 <= n < m:
        least = min(least, len(pieces) - 1 - int(0.04 * n))
    return sum(p in old for p in pieces) >= least


def greedy(texts: list[str]) -> list[bool]:
    """Which texts repeat an earlier one that isn't itself a repeat.

    Only earlier texts that hold a piece of the text are compared with it; no other can be like it,
    so the result is that of all comparisons. On small pages they are searched for the piece, on
    others an index of their letter runs gives them by the piece's rarest run.
    """
    kept: list[str] = []
    out: list[bool] = []
    seen: set[str] = set()
    whole = ""
    index: dict[str, list[int]] | None = None

    def put(i: int) -> None:
        for gram in {kept[i][j : j + GRAM] for j in range(len(kept[i]) - GRAM + 1)}:
            index[gram].append(i)

    def holders(piece: str):
        if index is None:
            return range(len(kept)) if piece in whole else ()
        few: list[int] | tuple = index.get(piece[:GRAM], ())
        for j in range(1, len(piece) - GRAM + 1):
            if not few:
                break
            other = index.get(piece[j : j + GRAM], ())
            few = other if len(other) < len(few) else few
        return few

    def repeats(t: str) -> bool:
        tried: set[int] = set()
        pieces = cut_pieces(t)
        for piece in pieces:
            for i in holders(piece):
                if i not in tried and piece in kept[i]:
                    tried.add(i)
                    if may_be_same(t, kept[i], pieces) and same(t, kept[i]):
                        return True
        return False

    for t in texts:
        hit = t in seen or repeats(t)
        if not hit:
            seen.add(t)
            kept.append(t)
            if index is not None:
                put(len(kept) - 1)
            elif len(whole) + len(t) < SEARCHED:
                whole += t + "\n"
            else:
                index = defaultdict(list)
                for i in range(len(kept)):
                    put(i)
        out.append(hit)
    return out


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(page_id, variant, idx) of paragraphs that repeat an earlier kept one of their page, nearly or within it."""
    some = rows.select(*KEY, "idx", "class_type", "verbatim", F.inline(F.array(F.struct(normalized(F.col("text")).alias("norm")))))
    some = some.where(eligible()).select(*KEY, "idx", "norm").repartition(*KEY).sortWithinPartitions(*KEY, "idx")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pages come one after the other; the last one of a batch may go on in the next
        key, idx, norm = None, [], []
        found: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for i, hit in zip(idx, greedy(norm), strict=True):
                if hit:
                    for c, v in zip(found, (*key, i), strict=True):
                        c.append(v)

        for batch in stream:
            for page, variant, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page, variant) != key:
                    close()
                    key, idx, norm = (page, variant), [], []
                idx.append(i)
                norm.append(t)
            if found[0]:
                yield out(found)
                found = ([], [], [])
        close()
        yield out(found)

    def out(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["page_id", "variant", "idx"])

    return some.mapInArrow(batches, "page_id bigint, variant int, idx int")


def drop_duplicates(rows: DataFrame) -> DataFrame:
    """Near duplicates become bad."""
    found = near_duplicates(rows).withColumn("_dup", F.lit(True))
    rows = rows.join(found, [*KEY, "idx"], "left")
    return rows.withColumn("class_type", F.when(F.col("_dup"), "bad").otherwise(F.col("class_type"))).drop("_dup")
