"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated passages go, the rest is packed."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowry.llm import chain_dedup, common, minhash_dedup, packing, toxicity
from winnowry.session import prepare


def stage(function):
    """Prepares the session, in which a stage may be the first to run."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(prepare(spark), docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. It learns from labelled rows outside the held-out fold.

    Null and empty texts stay; rows that share a doc_id are judged each; an empty table gives none.
    """
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"), toxicity.fold())
    return toxicity.clean(docs, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays.

    Rows without doc_id or without words stay; of rows that share the smallest doc_id the one of
    smallest text hash stays, once. Only the rows that go are gathered, by doc_id and text hash.
    """
    with common.scratch(spark):
        found = minhash_dedup.classes(docs.select("doc_id", "text"))
        gone = common.kept_table(found.where("not kept").select(F.struct("doc_id", "mark").alias("gone")).distinct(), "near-duplicates")
        shared = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    doc_id = docs["doc_id"].cast("bigint")
    possible, others = common.sieved(docs, F.xxhash64(doc_id, mark), gone, F.xxhash64("gone.doc_id", "gone.mark"))
    out = possible.join(gone, (doc_id == gone["gone"]["doc_id"]) & (mark == gone["gone"]["mark"]), "left_anti").unionByName(others)
    if not shared:
        return out
    blank = (F.col("doc_id").isNull()) | (F.length(F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))) == 0)
    return out.where(blank).unionByName(out.where(~blank).dropDuplicates(["doc_id", "text"]))


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat those of earlier documents are cut out; every document stays with what is left of it.

    Null and empty texts, rows without doc_id and, of rows that share one, all but those of the
    smallest text stay as they are; an empty table gives none.
    """
    return chain_dedup.cut(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, tokenised and packed into sequences. Null and empty texts are an end id alone; repeated rows are packed each; an empty table gives none."""
    import public_tokenizers as P

    return packing.pack(docs, functools.partial(packing.tokenise, path=P.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("packing", pack)]
#: No stage can be written in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage's rows are written and read again, and deleted once the next stage's are written."""
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
