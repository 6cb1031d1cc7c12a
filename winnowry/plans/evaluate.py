"""Scores of extracted text against what was wanted, and questions about runs."""

from __future__ import annotations

import difflib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

PRIORITY = ["ERROR", "EMPTY_PRED", "NON_LATIN", "WHITESPACE", "UNDER_EXTRACTION", "OVER_EXTRACTION", "PARTIAL", "GOOD"]


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), 0)


def lev_distance(pred: Column, gold: Column) -> Column:
    return F.levenshtein(pred, gold).cast("bigint")


def lev_similarity(pred: Column, gold: Column) -> Column:
    return 1 - F.levenshtein(pred, gold) / F.greatest(F.char_length(pred), F.char_length(gold), F.lit(1))


def lcs_length(a: list, b: list) -> int:
    masks: dict = defaultdict(int)
    for i, t in enumerate(a):
        masks[t] |= 1 << i
    full = (1 << len(a)) - 1
    s = full
    for t in b:
        u = s & masks.get(t, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


ROUGE = StructType([StructField(n, DoubleType()) for n in ("p", "r", "f")])


def rouge_l(pred: Column, gold: Column) -> Column:
    """struct(p, r, f) over token arrays: 1 if both are empty, 0 if one is."""

    @pandas_udf(ROUGE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = list(x), list(y)
            if not x or not y:
                out.append((1.0,) * 3 if not x and not y else (0.0,) * 3)
                continue
            n = lcs_length(x, y)
            p, r = n / len(x), n / len(y)
            out.append((p, r, 2 * p * r / (p + r) if n else 0.0))
        return pd.DataFrame(out, columns=["p", "r", "f"])

    return run(tokens(pred), tokens(gold))


def score(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    p, g = F.coalesce(F.col(pred), F.lit("")), F.coalesce(F.col(gold), F.lit(""))
    rows = rows.withColumn("_r", rouge_l(p, g))
    return rows.select("*", F.col("_r.p").alias("rougeL_p"), F.col("_r.r").alias("rougeL_r"), F.col("_r.f").alias("rougeL_f"), lev_distance(p, g).alias("lev_distance"), lev_similarity(p, g).alias("lev_similarity"), F.char_length(p).alias("pred_chars"), F.char_length(g).alias("gold_chars")).drop("_r")


def summarize(rows: DataFrame, metrics: list[str], by: list[str] = ()) -> DataFrame:
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(F.count("*").alias("n_docs"), *aggs)


def non_latin_fraction(c: Column) -> Column:
    letters = F.regexp_replace(c, "[^\\p{L}]", "")
    n = F.char_length(letters)
    return F.when(n > 0, F.char_length(F.regexp_replace(letters, "[a-zA-Z]", "")) / n).otherwise(F.lit(0.0))


def whitespace_only(pred: Column, gold: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, "(?U)\\s+", "")
    return (pred != gold) & (bare(pred) == bare(gold))


def failure_tags(pred: Column, gold: Column, metric: Column, error: Column) -> Column:
    share = F.char_length(pred) / F.greatest(F.char_length(gold), F.lit(1))
    empty = F.char_length(F.trim(pred)) == 0
    good = metric >= 0.95
    under, over, latin = share < 0.5, share > 1.5, non_latin_fraction(gold) > 0.30
    named = [("ERROR", error.isNotNull()), ("EMPTY_PRED", empty), ("NON_LATIN", latin), ("UNDER_EXTRACTION", under & ~empty), ("OVER_EXTRACTION", over), ("WHITESPACE", whitespace_only(pred, gold)), ("GOOD", good), ("PARTIAL", ~good & ~under & ~over)]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in named)))


def primary_tag(tags: Column) -> Column:
    return F.coalesce(*(F.when(F.array_contains(tags, t), t) for t in PRIORITY))


def tag_counts(rows: DataFrame, tags: str = "tags") -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def worst(rows: DataFrame, metric: str, n: int, key: str = "index") -> DataFrame:
    return rows.orderBy(F.col(metric), F.col(key)).limit(n)


def best(rows: DataFrame, metric: str, n: int, key: str = "index") -> DataFrame:
    return rows.orderBy(F.desc(metric), F.col(key)).limit(n)


def around_median(rows: DataFrame, metric: str, n: int, key: str = "index") -> DataFrame:
    """n rows around the middle one by metric."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.orderBy(metric, key)) - 1)
    size = rows.count()
    start = max(0, size // 2 - n // 2)
    return ranked.where((F.col("_k") >= start) & (F.col("_k") < start + n)).drop("_k")


def percentiles(rows: DataFrame, metric: str, points=(5, 25, 50, 75, 95)) -> DataFrame:
    """(percentile, value) by nearest rank, halves to even. Ranks come from counts of equal values, summed over values."""
    values = rows.where(F.col(metric).isNotNull()).groupBy(F.col(metric).alias("value")).agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.orderBy("value")))
    n = values.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    ranks = F.explode(F.array(*(F.struct(F.lit(p).alias("percentile"), F.lit(round(p / 100 * (n - 1))).alias("rank")) for p in points)))
    hit = values.withColumn("r", ranks).where((F.col("r.rank") < F.col("upto")) & (F.col("r.rank") >= F.col("upto") - F.col("c")))
    return hit.select("r.percentile", "value")


def breakdown(rows: DataFrame, attribute: str, metric: str) -> DataFrame:
    return rows.groupBy(attribute).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("median")).orderBy("mean")


def find(rows: DataFrame, gold=None, pred=None, url=None, tag=None, added=None, dropped=None, snapshot=None, predicate: Column | None = None, **flags) -> DataFrame:
    """Rows that meet every given condition; patterns are regular expressions."""
    for column, pattern in (("gold", gold), ("pred", pred), ("url", url)):
        if pattern is not None:
            rows = rows.where(F.col(column).rlike(pattern))
    if added is not None:
        rows = rows.where(F.exists(F.array_except(tokens(F.col("pred")), tokens(F.col("gold"))), lambda t: t.rlike(added)))
    if dropped is not None:
        rows = rows.where(F.exists(F.array_except(tokens(F.col("gold")), tokens(F.col("pred"))), lambda t: t.rlike(dropped)))
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    if snapshot is not None:
        rows = rows.where(F.col("snapshot") == snapshot)
    for name, value in flags.items():
        rows = rows.where(F.col(name) == value)
    return rows if predicate is None else rows.where(predicate)


def lookup(rows: DataFrame, ref: str | int, key: str = "warc_record_id"):
    """The one row of that index, id or unique beginning of an id."""
    if isinstance(ref, int) or str(ref).startswith("#"):
        found = rows.where(F.col("index") == int(str(ref).lstrip("#"))).limit(2).collect()
    else:
        found = rows.where(F.col(key) == ref).limit(2).collect() or rows.where(F.col(key).startswith(ref)).limit(2).collect()
    if len(found) != 1:
        raise KeyError(ref)
    return found[0]


def join_runs(records: DataFrame, predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Three tables by position; different row counts are an error."""
    n = {name: df.count() for name, df in (("records", records), ("predictions", predictions), ("metrics", metrics))}
    if len(set(n.values())) != 1:
        raise ValueError(f"row counts differ: {n}")
    seen = set(records.columns)
    for df in (predictions, metrics):
        new = [c for c in df.columns if c not in seen]
        records = records.join(df.select("index", *new), "index")
        seen.update(new)
    return records


def compare(a: DataFrame, b: DataFrame, metric: str, key: str = "index") -> DataFrame:
    """Change of a metric from run a to run b, largest loss first."""
    if a.count() != b.count():
        raise ValueError("the runs have different numbers of rows")
    old, new = a.select(key, F.col(metric).alias("before")), b.select(key, F.col(metric).alias("after"))
    return old.join(new, key).withColumn("delta", F.col("after") - F.col("before")).orderBy("delta", key)


def improved_regressed(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("delta") > 1e-9).alias("improved"), F.count_if(F.col("delta") < -1e-9).alias("regressed"))


def histogram(rows: DataFrame, metric: str) -> DataFrame:
    return rows.groupBy(F.least(F.floor(F.col(metric) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


DIFF = ArrayType(StructType([StructField(n, StringType()) for n in ("op", "gold", "pred")]))


def diff(gold: Column, pred: Column, words: bool = True) -> Column:
    @pandas_udf(DIFF)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = (x.split(), y.split()) if words else (list(x), list(y))
            put = " ".join if words else "".join
            return [{"op": op, "gold": put(x[i:j]), "pred": put(y[k:m])} for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()]

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(gold, pred)


def category(pred: Column, gold: Column, metric: Column, noisy: Column) -> Column:
    share = F.char_length(pred) / F.greatest(F.char_length(gold), F.lit(1))
    return F.when(noisy, "gold-noise").when(F.char_length(F.trim(pred)) == 0, "empty").when(metric >= 0.95, "great").when(share > 1.25, "over").when(share < 0.75, "under").otherwise("partial")


def oracle_labels(paragraphs: DataFrame, gold: DataFrame, least: float = 0.6) -> DataFrame:
    """Adds overlap, the share of the paragraph's tokens that the page's wanted text has, and keep: at least that share.

    The wanted text comes ahead of its page's paragraphs and is kept as a set while they pass, so
    the work is in proportion to the tokens; an array would be searched for each of them.
    """
    names = paragraphs.columns
    wanted = gold.select("page_id", F.col("gold").alias("_g"), F.lit(0).alias("_k"))
    both = paragraphs.withColumns({"_g": F.lit(None).cast("string"), "_k": F.lit(1)}).unionByName(wanted, allowMissingColumns=True)
    both = both.where("page_id is not null").repartition("page_id").sortWithinPartitions("page_id", "_k")
    both = both.select(*names, "_k", tokens(F.when(F.col("_k") == 0, F.col("_g")).otherwise(F.col("text"))).alias("_t"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for batch in stream:
            found = batch.column("_t")
            ends = [0, *accumulate(n or 0 for n in pc.list_value_length(found).to_pylist())]
            values = found.flatten().to_pylist()
            at, share = [], []
            for i, (page, paragraph) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("_k").to_pylist(), strict=True)):
                if page != key:
                    key, sets = page, []
                own = values[ends[i] : ends[i + 1]]
                if not paragraph:
                    sets.append(set(own))
                    continue
                for known in sets:
                    at.append(i)
                    share.append(sum(t in known for t in own) / len(own) if own else 0.0)
            yield batch.select(names).take(pa.array(at, pa.int32())).append_column("overlap", pa.array(share, pa.float64()))

    schema = StructType([*(StructField(f.name, f.dataType) for f in paragraphs.schema), StructField("overlap", DoubleType())])
    return both.mapInArrow(batches, schema).withColumn("keep", F.col("overlap") >= least)


def oracle_buckets(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(F.when(F.col("overlap") >= 0.7, "content").when(F.col("overlap") <= 0.15, "noise").otherwise("mixed").alias("bucket")).agg(F.count("*").alias("n"))


def learn_char_repair(pairs: DataFrame, width: int = 2) -> DataFrame:
    """(before, after, char): what stands in clean text between width characters that surround U+FFFD in broken text.

    width 2 asks for 3 cases of which 80 % agree, 1 for 5 and 85 %.
    """
    least, share = (3, 0.80) if width == 2 else (5, 0.85)
    w = str(width)
    marked = pairs.select("gold", F.explode(F.regexp_extract_all("pred", F.lit(f"(?s).{{{w}}}�.{{{w}}}"), 0)).alias("ctx"))
    marked = marked.select("gold", F.substring("ctx", 1, width).alias("before"), F.substring("ctx", width + 2, width).alias("after")).where("not contains(before || after, '�')").distinct()
    spot = F.regexp_extract_all("gold", F.concat(F.lit("(?s)\\Q"), F.col("before"), F.lit("\\E(.)\\Q"), F.col("after"), F.lit("\\E")), F.lit(1))
    counted = marked.select("before", "after", F.explode(spot).alias("char")).groupBy("before", "after", "char").agg(F.count("*").alias("n"))
    per = Window.partitionBy("before", "after")
    ranked = counted.withColumns({"total": F.sum("n").over(per), "k": F.row_number().over(per.orderBy(F.desc("n"), "char"))})
    return ranked.where((F.col("k") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select("before", "after", "char")


def guard_split(split: str, allow_test: bool = False) -> str:
    if split == "test" and not allow_test:
        raise ValueError("the test split is held back")
    return split
