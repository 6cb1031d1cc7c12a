"""Threshold-scaled document fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_hashes

FRACTION = 0.25
BUCKETS = 65536


def limit_of(fraction: float) -> int:
    return int(-(2**63) + fraction * 2**64) if fraction < 1 else 2**63 - 1


def with_sketch(df: DataFrame, text: Column, out: str, words: int = 5, fraction: float = FRACTION) -> DataFrame:
    """Adds out: sorted distinct hashes of the text's word shingles that lie below fraction of all hashes.

    Such sketches merge by union and estimate containment whatever the two texts' sizes. A text
    of fewer words gives one shingle; one whose shingles all lie above keeps the least of them; a
    null or blank text has none. Equal texts have equal sketches.
    """
    limit = limit_of(fraction)
    df = df.withColumn("_w", word_hashes(text))
    last = F.greatest(F.size("_w") - words, F.lit(0))
    shingle = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(words))))
    df = df.withColumn("_h", F.when(F.size("_w") > 0, shingle).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_k", F.filter("_h", lambda h: h <= F.lit(limit)))
    kept = F.when(F.size("_k") > 0, F.col("_k")).when(F.size("_h") > 0, F.array(F.array_min("_h"))).otherwise(F.col("_k"))
    return df.withColumn(out, F.array_sort(F.array_distinct(kept))).drop("_w", "_h", "_k")


def merged(a: str, b: str, fraction: float = FRACTION) -> Column:
    """The sketch of two texts together; a hash above the fraction stays only where there's none below."""
    limit = F.lit(limit_of(fraction))
    both = F.array_union(a, b)
    below = F.filter(both, lambda h: h <= limit)
    return F.array_sort(F.when((F.size(below) > 0) | (F.size(both) == 0), below).otherwise(F.array(F.array_min(both))))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: str, b: str) -> Column:
    """Estimated containment of the smaller sketch in the other: 1 for equal ones, 0 if only one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def as_string(sketch: str) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lower(F.hex(h))))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like it is to that and to the next document.

    Next is by ascending doc_id (of repeated ids: by text; null ids come first, as one group), after the last the
    first. Each row's next one is found by a window over buckets of ids of about 1,024 rows; only
    buckets' first rows cross to the bucket before. Their number is at most BUCKETS, so they may
    be broadcast. Other columns are dropped; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    count = max(1, min(BUCKETS, -(-n // 1024)))
    low = low or 0
    width = max(1, -(-((high or 0) - low + 1) // count))
    docs = docs.withColumn("bucket", F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(-1)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    ring = Window.partitionBy(F.lit(1)).orderBy("bucket")  # at most BUCKETS + 1 rows
    wrap = F.first("first_id").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    back = F.last("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("bucket", "first_id", F.coalesce(F.lag("bucket").over(ring), back).alias("for_bucket"), wrap.alias("_w")).drop("_w")
    heads = docs.join(F.broadcast(firsts.select(F.col("bucket"), F.col("first_id"), "for_bucket")), "bucket").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy("text"))).where("_n = 1")
    heads = with_sketch(heads.select(F.col("for_bucket").alias("bucket"), F.col("text").alias("head_text")), F.col("head_text"), "head_sketch")
    w = Window.partitionBy("bucket").orderBy(*order)
    own = with_sketch(docs, F.col("text"), "sketch")
    own = own.select("*", F.lead("text").over(w).alias("lead_text"), F.lead("sketch").over(w).alias("lead_sketch"))
    own = own.join(heads, "bucket", "left")
    after = F.coalesce("lead_text", "head_text")
    own = own.select("doc_id", "text", "sketch", after.alias("next_text"), F.coalesce("lead_sketch", "head_sketch").alias("next_sketch"))
    n_chars = F.char_length("text")
    cut = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - cut), F.substring("next_text", F.lit(1), cut))
    own = own.select("doc_id", n_chars.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    own = with_sketch(own, F.col("edited"), "edited_sketch")
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string("sketch").alias("fingerprint"),
        as_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )
