"""What agents know: documents with scores, and checks of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions.scoring import confidence_level
from marlpit.sources.tables import upsert

KNOWLEDGE = "document_id string, content string, score double, confidence_level int"


def add_knowledge(known: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, content) come in with score and level 0; those that are known start anew."""
    fresh = documents.select("document_id", "content", F.lit(0.0).alias("score"), F.lit(0).alias("confidence_level"))
    return upsert(known, fresh, ["document_id"])


def update_scores(known: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known documents with new scores (document_id, score), and the level each score gave: 0 for unknown documents.

    Levels of updates are rounded, halves to even, and keep what lies outside 0 to 10. Of several scores of one document
    the highest counts.
    """
    level = F.bround(F.col("new") * 10.0, 0).cast("int")
    asked = scores.groupBy("document_id").agg(F.max("score").alias("new"))
    after = known.join(asked, "document_id", "left").select(
        "document_id", "content", F.coalesce("new", "score").alias("score"), F.when(F.col("new").isNotNull(), level).otherwise(F.col("confidence_level")).alias("confidence_level")
    )
    there = known.select("document_id", F.lit(1).alias("there"))
    said = asked.join(there, "document_id", "left").select("document_id", F.when(F.col("there") == 1, level).otherwise(0).alias("confidence_level"))
    return after, said


def agent_level(known: DataFrame, agent: str, of: str = "SPM Agent") -> DataFrame:
    """One row (agent, confidence): the level of the mean score; 0 for another agent or without documents."""
    mean = known.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))
    return mean.select(F.lit(agent).alias("agent"), (confidence_level(F.col("mean")) if agent == of else F.lit(0)).alias("confidence"))


def without_repeats(rows: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Rows as they are; reading them fails if a key comes twice."""
    own = rows.select(F.struct(*rows.columns).alias("row"), F.struct(*keys).alias("key"))
    repeated = own.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("repeated"))
    named: Column = F.concat_ws(", ", *[F.col(f"key.{k}").cast("string") for k in keys])
    failing = F.when(F.col("repeated"), F.raise_error(F.concat(F.lit(f"{what} exists already: "), named)).cast("boolean")).otherwise(F.lit(True))
    return own.join(repeated, "key", "left").filter(failing).select("row.*")
