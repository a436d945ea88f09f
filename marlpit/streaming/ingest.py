"""Files as a stream: new texts are cleaned, cut into chunks and stored, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlpit.functions.text import clean
from marlpit.operators.chunking import chunk
from marlpit.operators.ingest import UNKNOWN
from marlpit.sources.tables import members, store


def last_arrived(batch: DataFrame) -> DataFrame:
    """Of each document the row that arrived last, by the file's time, then its name, then the text."""
    columns = ["document_id", "text", "sha256", "path"]
    return batch.groupBy("document_id").agg(F.max_by(F.struct(*columns), F.struct("arrived", "path", "text")).alias("row")).select("row.*")


def ingest_stream(spark: SparkSession, source: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (document_id, text) in a folder, as they come; a content that a stored document has is skipped.

    Known contents are those in the stored documents table, so the stream itself keeps no state. Of equal contents in a
    batch the document of the smallest id is taken. Chunks are stored before their documents, both by key, so a batch
    that runs again after a failure changes nothing that it has stored, and leaves nothing out.
    """
    rows = spark.readStream.schema("document_id string, text string").parquet(source)
    docs = rows.select("document_id", clean("text").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("path")).withColumn("sha256", F.sha2("text", 256))

    def keep(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        known = members(session, folder, "documents", batch.select("sha256")).select("sha256").distinct()
        fresh = last_arrived(batch).join(known, "sha256", "left_anti")
        first = fresh.groupBy("sha256").agg(F.min_by(F.struct("document_id", "text", "path"), "document_id").alias("row")).select("sha256", "row.*")
        constant = [F.lit(v).alias(k) for k, v in UNKNOWN.items()]
        store(session, folder, "chunks", chunk(first))
        store(session, folder, "documents", first.select("document_id", F.col("document_id").alias("title"), *constant, "sha256", F.col("path").alias("source_path"), F.current_timestamp().cast("timestamp_ntz").alias("last_updated")))

    return docs.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
