"""Dense and hybrid retrieval, reranking and the answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions import scoring
from marlpit.functions.vectors import cosine
from marlpit.operators import lexical

LEXICAL_WEIGHT, DENSE_WEIGHT, CANDIDATES = 0.4, 0.6, 10
NOTHING = "No relevant knowledge found."


def with_chunks(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with their chunks; those without a partner on either side go."""
    return vectors.join(chunks, "chunk_id")


def dense_search(vectors: DataFrame, query: Sequence[float], top: int = 5) -> DataFrame:
    """The best rows by cosine with one query vector; vectors without length go."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), asked), lexical.DIGITS)).filter("score is not null")
    return scored.orderBy(F.desc("score"), "chunk_id").limit(top)


def fuse(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Union of two results by chunk, weighted scores added; what both have comes from the first."""
    a, b = words.withColumnRenamed("score", "lexical"), vectors.withColumnRenamed("score", "dense")
    both = a.alias("a").join(b.alias("b"), F.col("a.chunk_id") == F.col("b.chunk_id"), "full_outer")
    score = LEXICAL_WEIGHT * F.coalesce("lexical", F.lit(0.0)) + DENSE_WEIGHT * F.coalesce("dense", F.lit(0.0))
    payload = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("chunk_id", "document_id", "sequence", "text")]
    return both.select(*payload, F.round(score, lexical.DIGITS).alias("score"))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], top: int = 5) -> DataFrame:
    """Ten candidates of each kind, fused. The ten nearest vectors are taken of chunks that are there, and named to the
    chunks' table as constants, so that it is read once for the words, once for names and once for ten texts."""
    words = lexical.search(chunks, query, CANDIDATES).select("chunk_id", "document_id", "sequence", "text", "score")
    near = dense_search(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), query_vector, CANDIDATES).select("chunk_id", "score").collect()
    scores = chunks.sparkSession.createDataFrame([(r.chunk_id, r.score) for r in near], "chunk_id string, score double")
    texts = chunks.filter(F.col("chunk_id").isin([r.chunk_id for r in near])).select("chunk_id", "document_id", "sequence", "text")
    return fuse(words, texts.join(F.broadcast(scores), "chunk_id")).orderBy(F.desc("score"), "document_id", "sequence").limit(top)


def keyword_reranker(query: str) -> Callable[[Column], Column]:
    """A stand-in for a model that scores pairs: the keyword score of a text."""
    return lambda text: scoring.scored(text, scoring.query_keywords(query))["score"]


def rerank(results: DataFrame, score: Callable[[Column], Column], top: int = 3) -> DataFrame:
    return results.withColumn("score", F.round(score(F.col("text")), lexical.DIGITS)).orderBy(F.desc("score"), "chunk_id").limit(top)


def answer(results: DataFrame, documents: DataFrame) -> DataFrame:
    """The best result with its document's title, null for an unknown document; a row that says so if there is none."""
    best = results.orderBy(F.desc("score"), "chunk_id").limit(1)
    named = documents.select("document_id", "title").join(F.broadcast(best), "document_id", "right").select(F.lit(True).alias("success"), F.col("text").alias("answer"), "title", "document_id", "chunk_id", "score")
    anything = best.agg(F.count("*").alias("n")).filter("n = 0")
    void = anything.select(F.lit(False).alias("success"), F.lit(NOTHING).alias("answer"), *[F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("document_id", "string"), ("chunk_id", "string"), ("score", "double"))])
    return named.unionByName(void)
