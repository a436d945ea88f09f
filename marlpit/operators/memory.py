"""Rules, memory, feedback and the record of a thought."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.text import new_id, utc_stamp
from marlpit.operators.substrings import contained, fields, index_memory
from marlpit.sources.scratch import written
from marlpit.sources.tables import store

STORED_CONFIDENCE = 0.85


def holds(content: Column, context: Column, asked: Column) -> Column:
    """True if a text in lower case is part of a memory's content or of a value of its context, whatever their case."""
    in_context = F.exists(F.map_values(context), lambda v: F.lower(v).contains(asked))
    return F.coalesce(F.lower(content).contains(asked), F.lit(False)) | F.coalesce(in_context, F.lit(False))


def remembered(entries: DataFrame, query: str) -> DataFrame:
    """Entries with the query in their content or in a value of their context, whatever the case."""
    return entries.filter(holds(F.col("content"), F.col("context"), F.lit(query.lower())))


def new_memory(content: Column, context: Column) -> list[Column]:
    """Columns of a new entry of the memory table; a null context is empty. Write them before they are read twice."""
    none = F.create_map().cast("map<string,string>")
    return [new_id().alias("memory_id"), content.alias("content"), F.coalesce(context, none).alias("context"), utc_stamp().alias("created_at"), F.lit(STORED_CONFIDENCE).alias("confidence")]


def store_memory(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    """Appends rows (content, context) to the stored memory and its index."""
    store(spark, folder, "memory", rows.select(*new_memory(F.col("content"), F.col("context"))))
    index_memory(spark, folder)


def eligible(rules: DataFrame) -> DataFrame:
    """Rules with both a form and keywords. Contents aren't tested."""
    return rules.filter("regex <> '' and size(keyword_list) > 0")


def rule_keywords(rules: DataFrame) -> DataFrame:
    """Distinct (pattern_id, name, keyword), as written: case tells keywords apart."""
    return rules.select("pattern_id", "name", F.explode("keyword_list").alias("keyword")).distinct()


def matches(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Names of the rules, in order, of which a keyword is part of the text. Rules are a short list of the session's."""
    lowered = F.lower(text)
    named = [F.when(F.exists(F.array(*[F.lit(k.lower()) for k in words]), lambda k: lowered.contains(k)), F.lit(name)) for name, words in rules if words]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def memories_of(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """(asked, memories): in how many entries each text (asked, in lower case, distinct) is remembered.

    Entries (content, context) are indexed by what they contain, so that a text meets only those that may contain it.
    """
    entries = written(memory.select(F.monotonically_increasing_id().alias("entry"), "content", "context"))
    texts = fields(entries, "entry")
    return contained(queries, texts).groupBy("asked").agg(F.count("*").alias("memories"))


def thoughts(queries: DataFrame, text: str, memory: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], id_col: str) -> DataFrame:
    """(id, memories, patterns, confidence, final_reasoning, intermediate_steps) of every query: HIGH with any memory or
    pattern, else MEDIUM.

    Memories (content, context) count as `remembered` finds them. Each distinct query is compared once. A null query
    remembers nothing. Steps are recorded in order: what was understood, how many memories were retrieved and which
    patterns were found, each with its text; those of the last two have the number and the names themselves.
    """
    counts = memories_of(queries.select(F.lower(text).alias("asked")).distinct(), memory)
    named = queries.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.lower(text).alias("asked"), F.coalesce(matches(F.col(text), rules), F.array().cast("array<string>")).alias("names"))
    joined = named.join(counts, "asked", "left").withColumn("memories", F.coalesce("memories", F.lit(0)).cast("long"))
    patterns = F.when(F.size("names") > 0, F.concat_ws(", ", "names")).otherwise("none")
    reasoning = F.format_string("Based on %d relevant memories and %d pattern matches, I can provide a confident response about '%s'", "memories", F.size("names"), "text")
    level = F.when((F.col("memories") > 0) | (F.size("names") > 0), "HIGH").otherwise("MEDIUM")
    none = F.lit(None)
    recorded = (
        ("understanding", F.format_string("Understanding query: '%s'", "text"), none, none),
        ("memory_retrieval", F.format_string("Retrieved %d relevant memories", "memories"), F.col("memories"), none),
        ("pattern_analysis", F.format_string("Identified %d matching patterns: %s", F.size("names"), patterns), none, F.col("names")),
    )
    steps = F.array(*[F.struct(F.lit(step).alias("step"), content.alias("content"), number.cast("long").alias("memories_count"), found.cast("array<string>").alias("patterns")) for step, content, number, found in recorded])
    return joined.select(F.col("id").alias(id_col), "memories", patterns.alias("patterns"), level.alias("confidence"), reasoning.alias("final_reasoning"), steps.alias("intermediate_steps"))


def stamped(thoughts: DataFrame) -> DataFrame:
    """Thoughts with an id and a time of their own (thought_id, created_at). Write them before they are read twice."""
    return thoughts.select(new_id().alias("thought_id"), "*", utc_stamp().alias("created_at"))


def feedback_memory(feedback: DataFrame) -> DataFrame:
    """Memory entries of (doc_id, user_id, is_correct, comments, and suggested_tags if there is such a column).

    Context says of each whose feedback it is; comments and tags stand in it only where they are given.
    """
    said = F.when(F.col("is_correct"), "Positive").otherwise("Negative")
    truth = F.when(F.col("is_correct"), "True").otherwise("False")
    values = {"feedback_type": F.lit("user_feedback"), "is_correct": truth, "doc_id": F.col("doc_id").cast("string"), "user_id": F.col("user_id")}
    if "suggested_tags" in feedback.columns:
        values["suggested_tags"] = F.concat_ws(", ", "suggested_tags")
    values["comments"] = F.col("comments")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    context = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    content = F.format_string("User feedback: %s for document %s", said, F.col("doc_id").cast("string"))
    return feedback.select("doc_id", content.alias("content"), context.alias("context"), F.lit(STORED_CONFIDENCE).alias("confidence"))
