"""What is said of a document when it is processed, and of documents when they are queried."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions import scoring
from marlpit.functions.text import base_name, document_type, new_id, utc_stamp

STATUS, AUTHOR = "indexed", "unknown"
# Confidence, blast radius and term frequency of a text without rules to score it by; its metadata's confidence.
UNRULED, READ_CONFIDENCE = (0.85, 0.5, 0.5), 0.85
#: Scores are rounded before a level is taken, so that the order of sums doesn't decide halves.
DIGITS = 9


@dataclass(frozen=True)
class Rule:
    """A rule is eligible with both a form and keywords. Neither is tested against texts here: keywords only score."""

    name: str
    regex: str | None
    keywords: tuple[str, ...]


def eligible_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.regex and r.keywords]


def level(score: Column) -> Column:
    return scoring.confidence_level(F.round(score, DIGITS))


def process_documents(docs: DataFrame, rules: Sequence[Rule], keys: Sequence[str], path: str = "path", text: str = "text") -> DataFrame:
    """Keys, then process_id, title, author, created_at, updated_at, document_type, status, metadata_confidence,
    patterns_found, confidence_score, blast_radius and term_frequency of every document.

    Texts are scored by the distinct keywords of eligible rules; the patterns found are the names of these rules. Without
    any the scores are fixed values. A null text is one that couldn't be read: type other, no pattern, scores of 0. A null
    path has no title and the type other. Ids are random and times are the query's: write rows before they are read twice.
    """
    known = eligible_rules(rules)
    words = list(dict.fromkeys(k for r in known for k in r.keywords))
    names = F.array(*[F.lit(r.name) for r in known]).cast("array<string>")
    # scores are a column of their own, so that each text is scored once
    own = docs.select(F.struct(*docs.columns).alias("row"), (scoring.scored(F.col(text), words) if words else F.lit(None)).alias("s"))
    there = F.col(f"row.{text}").isNotNull()
    scores = (level(F.col("s.score")) / 10.0, F.col("s.blast_radius"), F.col("s.term_frequency")) if words else tuple(F.lit(x) for x in UNRULED)
    found = [F.when(there, x).otherwise(0.0).alias(n) for n, x in zip(("confidence_score", "blast_radius", "term_frequency"), scores, strict=True)]
    return own.select(
        *[F.col(f"row.{k}").alias(k) for k in keys],
        new_id().alias("process_id"),
        base_name(f"row.{path}").alias("title"),
        F.lit(AUTHOR).alias("author"),
        utc_stamp().alias("created_at"),
        utc_stamp().alias("updated_at"),
        F.when(there, document_type(f"row.{path}")).otherwise("other").alias("document_type"),
        F.lit(STATUS).alias("status"),
        F.when(there, READ_CONFIDENCE).otherwise(0.0).alias("metadata_confidence"),
        F.when(there, names).otherwise(F.array().cast("array<string>")).alias("patterns_found"),
        *found,
    )


def query_documents(docs: DataFrame, query: str, limit: int, keys: Sequence[str], title: str = "title", text: str = "text", kind: str | None = None) -> DataFrame:
    """The best documents for a query: keys, title, score from 0 to 1, confidence_level, blast_radius, term_frequency,
    type ("unknown" unless a column of types is named), by falling weighted score, then keys.

    Null texts are no results.
    """
    scored = docs.filter(F.col(text).isNotNull()).select(F.struct(*docs.columns).alias("row"), scoring.scored(F.col(text), scoring.query_keywords(query)).alias("s"))
    own = lambda c: F.col(f"row.{c}")
    best = scored.orderBy(F.desc(F.round("s.score", 6)), *map(own, keys)).limit(limit)
    confidence = level(F.col("s.score"))
    parts = [F.col(f"s.{c}").alias(c) for c in ("blast_radius", "term_frequency")]
    return best.select(*[own(k).alias(k) for k in keys], own(title).alias("title"), (confidence / 10.0).alias("score"), confidence.alias("confidence_level"), *parts, (own(kind) if kind else F.lit("unknown")).alias("type"), F.col("s.matching_keywords").alias("matching_keywords"))
