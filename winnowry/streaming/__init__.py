"""Extraction on streams: segmentation is row-local; classification needs a page's neighbours and runs per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from winnowry.operators import paragraphs
from winnowry.plans import extract


def segment_stream(pages: DataFrame) -> DataFrame:
    return paragraphs.from_pages(pages, variants=False)


def extract_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives each batch's documents to sink; call awaitTermination() on what it returns."""
    return pages.writeStream.foreachBatch(lambda batch, number: sink(extract.extract(batch), number)).option("checkpointLocation", checkpoint).start()
