"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    from . import bpe

    return bpe.digests(common.read(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op7_packing(spark, sf_dir):
    import functools

    import public_tokenizers as P

    from . import packing

    tokens = functools.partial(packing.tokenise, path=P.path("word_bpe_49k.json"))
    return packing.pack(common.read(spark, sf_dir, "documents"), tokens)


def op4_fingerprints(spark, sf_dir):
    from . import fingerprints

    return fingerprints.compare_with_edits(common.read(spark, sf_dir, "documents"))


def op8_kneser_ney(spark, sf_dir):
    from . import kneser_ney

    docs = common.read(spark, sf_dir, "documents")
    return kneser_ney.score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1)


def op2_toxicity(spark, sf_dir):
    from . import toxicity

    return toxicity.score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark, sf_dir):
    from . import embedding_dedup

    return embedding_dedup.dedup(common.read(spark, sf_dir, "embeddings"))


def op6_minhash_dedup(spark, sf_dir):
    from . import minhash_dedup

    return minhash_dedup.dedup(common.read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark, sf_dir):
    from . import suffix_dedup

    return suffix_dedup.dedup(common.read(spark, sf_dir, "documents"))


def op1_html_text(spark, sf_dir):
    from . import html_text

    return html_text.extract(common.read(spark, sf_dir, "pages"))


def op9_chain_dedup(spark, sf_dir):
    from . import chain_dedup

    return chain_dedup.dedup(common.read(spark, sf_dir, "documents"))


QUERIES = {
    "op9_chain_dedup": op9_chain_dedup,
    "op1_html_text": op1_html_text,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op7_packing": op7_packing,
    "op4_fingerprints": op4_fingerprints,
    "op8_kneser_ney": op8_kneser_ney,
}
ORACLES: dict[str, str] = {}
