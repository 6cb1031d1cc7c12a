"""Output formats and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag() -> Column:
    return F.when(F.col("class_type") != "good", "b").when(F.coalesce(F.col("heading"), F.lit(False)), "h").otherwise("p")


def default(rows: DataFrame, boilerplate: bool = False) -> DataFrame:
    """Lines <p>, <h> and, if wanted, <b> before the escaped text."""
    rows = rows if boilerplate else rows.where("class_type = 'good'")
    return rows.select("page_id", "idx", F.concat(F.lit("<"), _tag(), F.lit("> "), escape(F.col("text"))).alias("line"))


def detailed(rows: DataFrame) -> DataFrame:
    heading = F.coalesce(F.col("heading"), F.lit(False)).cast("int").cast("string")
    head = F.format_string('<p class="%s" cfclass="%s" heading="%s" xpath="%s"> ', F.col("class_type"), F.coalesce(F.col("cf_class"), F.lit("")), heading, F.col("xpath"))
    return rows.select("page_id", "idx", F.concat(head, escape(F.col("text"))).alias("line"))


def krdwrd(rows: DataFrame) -> DataFrame:
    """Class number and text of each text node: 3 good, 2 heading that isn't sure, 1 bad."""
    code = F.when(F.col("class_type") == "good", F.when(F.coalesce(F.col("heading"), F.lit(False)), 2).otherwise(3)).otherwise(1)
    nodes = rows.select("page_id", "idx", code.alias("code"), F.posexplode("text_nodes").alias("pos", "node")).where("trim(node) <> ''")
    return nodes.select("page_id", "idx", "pos", F.concat_ws("\t", F.col("code").cast("string"), F.trim("node")).alias("line"))


def document_text(rows: DataFrame) -> DataFrame:
    kept = rows.where("class_type = 'good'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("parts"))
    return kept.select("page_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))


def write_json(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ("tag", "dataset", "split")) -> None:
    rows.write.mode("overwrite").partitionBy(*[c for c in partition_by if c in rows.columns]).json(path)
