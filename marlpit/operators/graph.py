"""Knowledge graph: entities and relationships, upserts and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.sources.tables import KEYS, upsert

# Kinds of entities and of relationships.
ENTITY_TYPES = ("document", "process", "person", "system", "metric", "configuration", "incident", "knowledge_article")
RELATION_TYPES = ("related_to", "depends_on", "contains", "generates", "uses", "monitors", "configures", "triggers", "resolves")


def checked(kind: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(kind.isin(*allowed), kind).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(kind, F.lit("null")))))


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming.withColumn("entity_type", checked(F.col("entity_type"), ENTITY_TYPES)), KEYS["graph_entities"])


def upsert_relationships(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming.withColumn("relation_type", checked(F.col("relation_type"), RELATION_TYPES)), KEYS["graph_relationships"])


def metadata(column: str) -> Column:
    """Stored JSON as a map: null or empty text gives an empty map, the text `null` gives null."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", empty).otherwise(F.from_json(column, "map<string,string>"))


def entities(table: DataFrame, entity_type: str | None = None) -> DataFrame:
    return table if entity_type is None else table.filter(F.col("entity_type") == entity_type)


def neighbours(edges: DataFrame, entity_id: str) -> DataFrame:
    """Edges at either end of one entity, as stored; a loop comes once."""
    return edges.filter((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))


def neighbours_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at either end of many entities (id): two joins by key, each edge once."""
    out = edges.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    into = edges.join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    return out.unionByName(into).dropDuplicates(KEYS["graph_relationships"])
