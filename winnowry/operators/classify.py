"""Content or boilerplate: features, thresholds, and the passes over neighbours as window functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowry.functions import stopwords
from winnowry.functions.text import strip, words

KEY = ("page_id", "variant")


@dataclass(frozen=True)
class Thresholds:
    max_link_density: float = 0.2
    length_low: int = 40
    length_high: int = 60
    stopwords_low: float = 0.15
    stopwords_high: float = 0.20
    no_headings: bool = False
    max_heading_distance: int = 200
    heading_prepass: bool = False

    def without_language(self) -> Thresholds:
        """For pages without stop words: none is asked for."""
        return Thresholds(**{**self.__dict__, "stopwords_low": 0.0, "stopwords_high": 0.0})


def features(rows: DataFrame, stop: list[str] | dict[str, list[str]], language: str | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds length, words, stopwords, both densities and heading."""
    rows = rows.withColumn("_words", words(F.col("text")))
    hit = stopwords.hits(F.col("_words"), stop, F.col(language) if language else None)
    rows = rows.withColumns({"length": F.char_length("text"), "words": F.size("_words"), "stopwords": hit}).drop("_words")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    heading = F.lit(False) if t.no_headings else F.col("dom_path").rlike("\\bh\\d\\b")
    return rows.withColumns({"stopword_density": share("stopwords", "words"), "link_density": share("chars_in_links", "length"), "heading": heading})


def context_free(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds cf_class: good, neargood, short or bad by the paragraph alone."""
    c = F.col
    cf = (
        F.when(c("link_density") > t.max_link_density, "bad")
        .when(c("text").contains("\u00a9") | c("text").contains("&copy"), "bad")
        .when(c("dom_path").contains("select"), "bad")
        .when((c("length") < t.length_low) & (c("chars_in_links") > 0), "bad")
        .when(c("length") < t.length_low, "short")
        .when((c("stopword_density") >= t.stopwords_high) & (c("length") > t.length_high), "good")
        .when(c("stopword_density") >= t.stopwords_high, "neargood")
        .when(c("stopword_density") >= t.stopwords_low, "neargood")
        .otherwise("bad")
    )
    return rows.withColumn("cf_class", cf)


def _order():
    w = Window.partitionBy(*KEY).orderBy("idx")
    return w, w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)


def _decided(c: Column, near: bool = False) -> Column:
    return F.when(c.isin("good", "bad", *(("neargood",) if near else ())), c)


def in_context(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds class_type (good or bad) from the neighbours' classes; all passes share one partitioning and order."""
    _, before, after = _order()
    previous = lambda e: F.coalesce(F.last(e, ignorenulls=True).over(before), F.lit("bad"))
    following = lambda e: F.coalesce(F.first(e, ignorenulls=True).over(after), F.lit("bad"))
    cf = F.col("cf_class")
    if t.heading_prepass:
        so_far = F.coalesce(F.sum("length").over(before), F.lit(0))
        rows = rows.withColumn("_at", so_far)
        rows = rows.withColumn("_next", F.first(F.when(cf == "good", F.col("_at")), ignorenulls=True).over(after))
        lifted = F.col("heading") & (cf == "short") & (F.col("_next") - F.col("_at") - F.col("length") <= t.max_heading_distance)
        rows = rows.withColumn("cf_class", F.when(F.coalesce(lifted, F.lit(False)), "neargood").otherwise(cf)).drop("_at", "_next")
    rows = rows.withColumns({"_p": previous(_decided(cf)), "_n": following(_decided(cf)), "_pn": previous(_decided(cf, True)), "_nn": following(_decided(cf, True))})
    mixed = ((F.col("_p") == "bad") & (F.col("_pn") == "neargood")) | ((F.col("_n") == "bad") & (F.col("_nn") == "neargood"))
    second = F.when(cf != "short", cf).when(F.col("_p") == F.col("_n"), F.col("_p")).when(mixed, "good").otherwise("bad")
    rows = rows.withColumn("_c2", second)
    c2 = F.col("_c2")
    rows = rows.withColumns({"_p": previous(_decided(c2)), "_n": following(_decided(c2))})
    third = F.when(c2 != "neargood", c2).when((F.col("_p") == "bad") & (F.col("_n") == "bad"), "bad").otherwise("good")
    rows = rows.withColumns({"_c3": third, "_at": F.coalesce(F.sum("length").over(before), F.lit(0))})
    rows = rows.withColumn("_next", F.first(F.when(F.col("_c3") == "good", F.col("_at")), ignorenulls=True).over(after))
    lifted = F.col("heading") & (F.col("_c3") == "bad") & (cf != "bad") & (F.col("_next") - F.col("_at") - F.col("length") <= t.max_heading_distance)
    out = rows.withColumn("class_type", F.when(F.coalesce(lifted, F.lit(False)), "good").otherwise(F.col("_c3")))
    return out.drop("_p", "_n", "_pn", "_nn", "_c2", "_c3", "_at", "_next")


def merge_table_rows(rows: DataFrame, least_rows: int = 8, least_kept: int = 2, max_links: float = 0.6, max_spread: float = 0.4, max_median: int = 160) -> DataFrame:
    """All data rows of a long even table are good if some of them are."""
    key = F.regexp_extract("xpath", "^(.*/table\\[\\d+\\])", 1)
    inside = F.array_contains(F.split(F.lower("dom_path"), "\\."), "tr") & (strip(F.col("text")) != "") & (key != "")
    rows = rows.withColumn("_t", F.when(inside & (F.col("link_density") < max_links), key))
    w = Window.partitionBy(*KEY, "_t")
    length = F.col("length")
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy("length", "idx")))
    median = F.max(F.when(F.col("_rank") == F.floor(F.count("*").over(w) / 2) + 1, length)).over(w)
    even = F.col("_t").isNotNull() & (F.count("*").over(w) >= least_rows) & (F.sum(F.when(F.col("class_type") == "good", 1).otherwise(0)).over(w) >= least_kept)
    even = even & (F.avg(length).over(w) > 0) & (median <= max_median) & (F.stddev_pop(length).over(w) <= max_spread * F.avg(length).over(w))
    return rows.withColumn("_even", even).withColumn("class_type", F.when(F.col("_even"), "good").otherwise(F.col("class_type"))).drop("_t", "_rank", "_even")


BARE, ORDINAL = "^(-|\\d{1,3}\\.)$", "^(\\d{1,3})\\.$"


def _kept_neighbours(rows: DataFrame, names: dict[str, Column]) -> DataFrame:
    """lead and lag among kept rows only: other rows sort apart."""
    w = Window.partitionBy(*KEY, "_kept").orderBy("idx")
    rows = rows.withColumn("_kept", F.col("class_type") == "good")
    return rows.withColumns({f"_{n}_{side}": F.when(F.col("_kept"), f(c).over(w)) for n, c in names.items() for side, f in (("lead", F.lead), ("lag", F.lag))}).drop("_kept")


def fix_list_markers(rows: DataFrame) -> DataFrame:
    """A list mark alone in a kept paragraph, or alone on its line, goes before the text that follows."""
    bare = strip(F.col("text")).rlike(BARE)
    item = F.array_contains(F.split(F.lower("dom_path"), "\\."), "li")
    rows = rows.withColumns({"_bare": bare, "_mark": F.when(bare & item, strip(F.col("text")))})
    rows = _kept_neighbours(rows, {"_bare": F.col("_bare"), "_mark": F.col("_mark")})
    kept = F.col("class_type") == "good"
    gives = kept & F.col("_mark").isNotNull() & (~F.col("__bare_lead"))
    takes = kept & ~F.col("_bare") & F.col("__mark_lag").isNotNull()
    text = F.when(F.coalesce(takes, F.lit(False)), F.concat_ws(" ", "__mark_lag", "text")).otherwise(F.col("text"))
    rows = rows.withColumns({"class_type": F.when(F.coalesce(gives, F.lit(False)), "bad").otherwise(F.col("class_type")), "text": text})
    inner = F.regexp_replace("text", "(^|\\n)(-|\\d{1,3}\\.)\\n(?=\\S)", "$1$2 ")
    return rows.withColumn("text", F.when(F.col("verbatim"), F.col("text")).otherwise(inner)).drop(*(c for c in rows.columns if c.startswith("_")))


def fix_doubled_numbers(rows: DataFrame) -> DataFrame:
    """Where at least two items of a page repeat their number after the mark, the second goes."""
    text = strip(F.col("text"))
    doubled = (F.col("class_type") == "good") & F.col("text").rlike("^(\\d{1,3})\\.\\s+\\1(?=\\s|$)")
    rows = rows.withColumns({"_num": F.nullif(F.regexp_extract(text, ORDINAL, 1), F.lit("")), "_lead_num": F.nullif(F.regexp_extract(text, "^(\\d{1,3})(?=\\s)", 1), F.lit("")), "_in": doubled})
    rows = _kept_neighbours(rows, {"num": F.col("_num"), "own": F.col("_lead_num")})
    gives, takes = F.col("_num") == F.col("_own_lead"), F.col("_lead_num") == F.col("_num_lag")
    w = Window.partitionBy(*KEY)
    hits = F.sum(F.when(F.coalesce(gives, F.lit(False)) | F.col("_in"), 1).otherwise(0)).over(w)
    rows = rows.withColumns({"_hits": hits, "_gives": F.coalesce(gives, F.lit(False)), "_takes": F.coalesce(takes, F.lit(False))})
    on = F.col("_hits") >= 2
    body = F.regexp_replace(text, "^\\d{1,3}\\s+", "")
    fixed = F.when(on & F.col("_in"), F.regexp_replace("text", "^(\\d{1,3})\\.\\s+\\1(?=\\s|$)", "$1.")).when(on & F.col("_takes"), F.concat(F.col("_lead_num"), F.lit(". "), body)).otherwise(F.col("text"))
    out = rows.withColumns({"text": fixed, "class_type": F.when(on & F.col("_gives"), "bad").otherwise(F.col("class_type"))})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


LABELS = "Follow Like Reply Share Tweet By by".split() + ["Full Story", "Posted by", "Read more", "Read More"]


def drop_ui_labels(rows: DataFrame) -> DataFrame:
    lone = strip(F.col("text")).isin(*LABELS)
    return rows.withColumn("class_type", F.when(lone, "bad").otherwise(F.col("class_type")))


def classify(rows: DataFrame, stop, language: str | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """All passes; rows of a handler are good as they are."""
    if stop is not None and not stop:
        t = t.without_language()
    ordinary = F.col("route") == "page"
    rows = in_context(context_free(features(rows, stop or [], language, t), t), t)
    rows = rows.withColumn("class_type", F.when(ordinary, F.col("class_type")).otherwise("good"))
    return drop_ui_labels(fix_doubled_numbers(fix_list_markers(merge_table_rows(rows))))
