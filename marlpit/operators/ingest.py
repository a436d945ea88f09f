"""Ingestion: texts of files become registered documents and chunks; chunks get vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.text import base_name, clean
from marlpit.operators.chunking import chunk
from marlpit.operators.identity import register
from marlpit.sources.pages import Parser
from marlpit.sources.scratch import written
from marlpit.sources.tables import members, read_texts, store, stored

# What a registration says of a document that nothing more is known of.
UNKNOWN = {"team_owner": "UNKNOWN", "document_type": "UNKNOWN", "visibility": "Internal", "version": "1.0.0"}


def registered(files: DataFrame, registry: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(path, sha256, document_id, known) of files (path, sha256, error), written once, without texts.

    A file that gave no text isn't registered: it has no hash here and no document id.
    """
    readable = files.select("path", F.when(F.col("error").isNull(), F.col("sha256")).alias("sha256"))
    return written(register(readable, registry, counted=counted))


def document_rows(found: DataFrame) -> DataFrame:
    """Rows of the documents table for contents that weren't known: of each the first file by path."""
    fresh = found.filter("document_id is not null and not known").groupBy("document_id", "sha256").agg(F.min("path").alias("source_path"))
    constant = [F.lit(v).alias(k) for k, v in UNKNOWN.items()]
    return fresh.select("document_id", base_name("source_path").alias("title"), *constant, "sha256", "source_path", F.current_timestamp().cast("timestamp_ntz").alias("last_updated"))


def document_chunks(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of the cleaned texts of documents, read from one file of each (document_id, path)."""
    named = contents.groupBy("document_id").agg(F.min("path").alias("its"))
    texts = files.join(named, files["path"] == named["its"]).select("document_id", clean("text").alias("text"))
    return chunk(texts)


def ingest_files(files: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of files (path, sha256, text, error): their document ids, new rows of documents, and chunks of new ones.

    Registration moves paths and hashes alone; texts are read once more, and only those of new contents.
    """
    found = registered(files, registry)
    return found, document_rows(found), document_chunks(found.filter("document_id is not null and not known"), files)


def ingest_folder(spark: SparkSession, source: str, folder: str, pattern: str = "*", limit: int | None = None, extractors: Mapping[str, Column | Parser] | None = None) -> DataFrame:
    """Reads, registers, cleans and cuts a folder's files and stores them, their documents and chunks.

    Gives the files' rows with their document_id, null where a file gave no text. Contents that are registered already
    keep their ids. Documents are stored first, then chunks of all stored documents that have none, from the stored
    files: what a failure leaves out comes with the next run, of whatever folder, and no id changes its content.
    """
    run = uuid.uuid4().hex
    store(spark, folder, "files", read_texts(spark, source, pattern, limit, extractors).withColumn("run", F.lit(run)))
    files = stored(spark, folder, "files")
    own = files.filter(F.col("run") == run).drop("run")
    known = members(spark, folder, "documents", own.filter("error is null").select("sha256"))
    found = registered(own, known.select("document_id", "sha256"), stored(spark, folder, "documents").select("document_id"))
    store(spark, folder, "documents", document_rows(found))
    uncut = stored(spark, folder, "documents").select("document_id", "sha256").join(stored(spark, folder, "chunks").select("document_id"), "document_id", "left_anti")
    paths = files.filter("error is null").select("path", "sha256").join(uncut, "sha256").select("document_id", "path")
    store(spark, folder, "chunks", document_chunks(written(paths), files))
    return own.drop("text").join(found.select(F.col("path").alias("its"), "document_id"), own["path"] == F.col("its")).drop("its")


def index_vectors(chunks: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(chunk_id, embedding) of chunks without a vector. embed makes an array of numbers of a text's column."""
    missing = chunks.select("chunk_id", "text").join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    return missing.select("chunk_id", embed(F.col("text")).cast("array<double>").alias("embedding"))


def index_stored(spark: SparkSession, folder: str, embed: Callable[[Column], Column]) -> None:
    """Stores vectors of stored chunks that have none."""
    store(spark, folder, "vectors", index_vectors(stored(spark, folder, "chunks"), stored(spark, folder, "vectors"), embed))


def to_json(vectors: DataFrame) -> DataFrame:
    """Vectors as JSON text, as they are kept by stores without arrays."""
    return vectors.select("chunk_id", F.to_json("embedding").alias("embedding_json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", F.from_json("embedding_json", "array<double>").alias("embedding"))
