"""Pages to main-content text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowry.functions import stopwords
from winnowry.functions.text import clean_wiki_markup
from winnowry.operators import classify, dedup, learned, paragraphs

STOP = {code: code for code in ("en", "fr", "de", "es")}


def language_of(html) -> F.Column:
    """The two letters of the page's html lang attribute."""
    return F.lower(F.regexp_extract(html, "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([a-z]{2})", 1))


def classified(pages: DataFrame, languages=tuple(STOP), t: classify.Thresholds = classify.Thresholds(), drop_repeats: bool = False, model=None, **options) -> DataFrame:
    """Paragraph rows of pages with their classes; stop words by the page's own language, English where that's unknown.

    drop_repeats makes paragraphs bad that repeat earlier kept ones of their page, exactly, nearly
    or within them. model is a fitted pipeline over learned.columns() that judges the paragraphs
    instead of the rules. Other options are those of paragraphs.from_pages.
    """
    stop = {code: stopwords.words(code) for code in languages}
    found = F.coalesce(F.nullif(language_of(F.col("html")), F.lit("")), F.lit("en"))
    # the language rides along with the page, so that no join brings it back
    pages = pages.select("page_id", "html", F.when(found.isin(*languages), found).otherwise("en").alias("lang"))
    rows = classify.classify(paragraphs.from_pages(pages, carry="lang", **options), stop, "lang", t)
    if model is not None:
        rows = learned.apply(learned.features(rows), model)
    return dedup.drop_duplicates(rows) if drop_repeats else rows


def documents(rows: DataFrame) -> DataFrame:
    """(page_id, n_paragraphs, n_kept, text): of a page's variants the one that keeps most; 1 and 2 only where they beat 0."""
    kept = F.col("class_type") == "good"
    # wiki marks are undone by paragraph: what one holds says nothing of the others, and verbatim text keeps its own
    rows = rows.withColumn("text", F.when(F.col("verbatim"), F.col("text")).otherwise(clean_wiki_markup(F.col("text"))))
    per = rows.groupBy("page_id", "variant").agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if(kept).alias("n_kept"),
        F.coalesce(F.sum(F.when(kept, F.char_length("text"))), F.lit(0)).alias("chars"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("idx", "text")))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    base = F.max(F.when(F.col("variant") == 0, F.col("chars"))).over(Window.partitionBy("page_id"))
    # long links are given back only to pages of which next to nothing was kept
    score = F.when((F.col("variant") == 2) & (base >= 300), F.lit(-1)).otherwise(F.col("chars"))
    best = F.max_by(F.struct("n_paragraphs", "n_kept", "text"), F.struct("score", -F.col("variant")))
    per = per.select("page_id", "variant", "n_paragraphs", "n_kept", text.alias("text"), score.alias("score"))
    return per.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.n_paragraphs", "b.n_kept", "b.text")


def extract(pages: DataFrame, **options) -> DataFrame:
    """One row a page; pages without any paragraph have empty text."""
    docs = documents(classified(pages, **options))
    ids = pages.select(F.col("page_id").cast("bigint").alias("page_id")).distinct()
    return ids.join(docs, "page_id", "left").select("page_id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("text", F.lit("")).alias("text"))


def needs_javascript(html, kept_chars) -> F.Column:
    """A large page of little kept text that is mostly script."""
    scripts = F.aggregate(F.regexp_extract_all(html, F.lit("(?is)<script[^>]*>(.*?)</script>"), 1), F.lit(0), lambda a, s: a + F.char_length(s))
    n = F.char_length(html)
    return (n >= 20000) & (kept_chars < 300) & (scripts / n > 0.30)
