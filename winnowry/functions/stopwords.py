"""Stop words by language, from Spark's own lists."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = {"da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish"}


def names() -> frozenset[str]:
    return frozenset(LANGUAGES.values())


def words(language: str) -> list[str]:
    """Sorted lower-cased stop words of a language, by name or two-letter code."""
    name = LANGUAGES.get(language.lower(), language.lower())
    if name not in names():
        raise ValueError(f"no stop words for {language!r}; there are {', '.join(sorted(names()))}")
    return sorted({w.strip().lower() for w in StopWordsRemover.loadDefaultStopWords(name) if w.strip()})


def from_file(spark, path: str) -> list[str]:
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct()
    return sorted(r.w for r in rows.collect())


def hits(tokens: Column, stop: list[str] | dict[str, list[str]], language: Column | None = None) -> Column:
    """How many tokens, punctuation and all, are stop words; with a dict, of the row's language."""
    if isinstance(stop, dict):
        out = F.lit(0)
        for code, listed in stop.items():
            out = F.when(language == code, hits(tokens, listed)).otherwise(out)
        return out
    if not stop:
        return F.lit(0)
    return F.size(F.filter(tokens, lambda w: F.lower(w).isin(*stop)))  # a hash set in the plan


def table(spark, languages: list[str]) -> DataFrame:
    return spark.createDataFrame([(code, w) for code in languages for w in words(code)], "lang string, word string")
