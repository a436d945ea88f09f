"""Overlapping chunks of text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", size: int = 1000, overlap: int = 150) -> DataFrame:
    """(chunk_id, document_id, sequence, char_start, char_end, text) of texts; an empty text has no chunk."""
    if overlap >= size:
        raise ValueError("overlap must be less than the chunk size")
    step, n = size - overlap, F.char_length(text_col)
    number = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    each = docs.filter(n > 0).select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"), F.explode(F.sequence(F.lit(1), number)).alias("sequence"))
    start = (F.col("sequence") - 1) * step
    return each.select(
        F.format_string("%s-CH-%06d", "document_id", "sequence").alias("chunk_id"),
        "document_id",
        "sequence",
        start.alias("char_start"),
        F.least(start + size, F.char_length("text")).alias("char_end"),
        F.substring("text", start + 1, F.lit(size)).alias("text"),
    )


def accumulated(parts: Iterable[DataFrame]) -> DataFrame:
    """Chunks of several documents or runs as one table, each as often as it was added."""
    return reduce(DataFrame.unionByName, parts)
