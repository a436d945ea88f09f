"""From raw documents to packed training sequences, in five stages.

Each stage works on all documents that the one before it kept, as they were written. All but the last return the
columns of documents, further ones with them, whatever their names. Each stage gives an empty table for an empty one, and
takes nulls in any column: a null text counts as empty, a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.llm import mixing, near_dedup, packing, quality, secret_scan
from marlpit.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored by the classifier's constant alone. Repeated rows share their fate. Without labels
    all documents stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity of 0.8 or more.

    It is the one of the smallest id, null ids before all others. Texts without words are no group; of repeats of an id
    and text one row stays.
    """
    return near_dedup.one_of_each(docs, width=5, percent=80)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; documents without any stay as they are. Null texts stay null, with their
    number of characters; other numbers of characters are counted anew."""
    scanned = docs.withColumn("text", secret_scan.redact("text"))
    return scanned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words take no part and go. Repeated rows are drawn each by itself.
    """
    taken = mixing.mix(docs, carry=docs.columns)
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("carried.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens. Null ids stay null; repeats have pieces each."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", no_near_duplicates),
    ("secret scan", no_secrets),
    ("source mix", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: SQL can't express the classifier, the signatures, the entropy windows or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs)
    return docs
