"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.functions.text import decode_html

RECORD = "html string, final_output string, warc_record_id string, url string, snapshot string, split string, has_table boolean, has_code boolean, has_list boolean"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of text files, one page each; ids by hash of the name."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"), F.col("value").alias("html"))


def binary_files(spark: SparkSession, path: str, encoding: str | None = None, default: str = "utf8", errors: str = "replace") -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), decode_html(F.col("content"), encoding, default, errors).alias("html"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """A split's gzipped JSON lines with an explicit index; blank lines don't count."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.monotonically_increasing_id().alias("index"), F.from_json("value", RECORD).alias("r")).select("index", "r.*")


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def warc_text(raw, header_charset=None):
    """Bytes of a capture: byte order mark, else the header's charset, else the page's own, else UTF-8 or cp1252."""
    mark = F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.decode(F.substring(raw, 4, 2_000_000_000), "UTF-8"))
    return F.coalesce(mark, decode_html(raw, None, "cp1252"))
