"""Column functions that score a text by keywords."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlpit.functions.text import n_tokens


def query_keywords(query: str, most: int = 10) -> list[str]:
    """The first words of a query, as written."""
    return query.split()[:most]


def _checked(keywords: Sequence[str]) -> None:
    if any(not k for k in keywords):
        raise ValueError("an empty keyword matches everywhere")


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _hits(lowered: Column, key: str) -> Column:
    """How often a text holds a key, overlaps counted. Where no end of a key is its beginning, hits can't overlap."""
    if any(key.startswith(key[at:]) for at in range(1, len(key))):
        return F.regexp_count(lowered, F.lit(f"(?={re.escape(key)})"))
    return ((F.char_length(lowered) - F.char_length(F.replace(lowered, F.lit(key), F.lit("")))) / len(key)).cast("int")


def blast_radius(text: Column, keywords: Sequence[str]) -> Column:
    """How close together a keyword's hits stand, averaged over keywords: 1 / (1 + exp(mean gap / 50)), 1 at most.

    Hits may overlap. The gaps of hits in order add up to the last place less the first, so no list of places is made.
    A keyword that is given m times, in any case, has its hits m times over.
    """
    _checked(keywords)
    lowered, parts = F.lower(text), []
    for key, times in Counter(k.lower() for k in keywords).items():
        hits = _hits(lowered, key) * times
        first = F.locate(key, lowered)
        last = F.char_length(lowered) - len(key) + 2 - F.locate(key[::-1], F.reverse(lowered))
        gap = (last - first) / F.greatest(hits - 1, F.lit(1))
        parts.append(F.when(hits >= 2, times / (1.0 + F.exp(gap / 50.0))).otherwise(0.0))
    return F.least(F.lit(1.0), _sum(parts) / F.lit(float(max(1, len(keywords)))))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How often keywords stand as whole words; a keyword that is given twice counts twice."""
    _checked(keywords)
    lowered = F.lower(text)
    # the key comes first in the form, as its letters are tried faster than the border before it
    count = lambda k: F.regexp_count(lowered, F.lit(rf"(?U){re.escape(k)}(?<=\b{re.escape(k)})\b")).cast("double")
    return _sum([count(k) * float(times) for k, times in Counter(k.lower() for k in keywords).items()])


def term_frequency(text: Column, keywords: Sequence[str]) -> Column:
    """Whole-word hits over the number of keywords and the root of the number of words, 1 at most."""
    if not keywords:
        return F.lit(0.0)
    root = F.greatest(F.lit(1.0), F.sqrt(n_tokens(text).cast("double")))
    return F.least(F.lit(1.0), keyword_hits(text, keywords) / (root * float(len(keywords))))


def contextual_relevance(text: Column, known_terms: Sequence[str] = ()) -> Column:
    """The share of known terms that are part of the text; a half if none is known."""
    terms = sorted({t.lower() for t in known_terms})
    if not terms:
        return F.lit(0.5)
    return _sum([F.lower(text).contains(t).cast("double") for t in terms]) / float(len(terms))


def weighted(blast: Column, frequency: Column, relevance: Column) -> Column:
    return blast * 0.4 + frequency * 0.3 + relevance * 0.3


def confidence_level(score: Column) -> Column:
    """0 to 10, halves rounded to even."""
    return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(score * 10.0, 0).cast("int")))


def matching_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Keywords that are part of the text, as given and in that order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]).cast("array<string>"), lambda k: F.lower(text).contains(F.lower(k)))


def scored(text: Column, keywords: Sequence[str], known_terms: Sequence[str] = ()) -> Column:
    """struct of all scores of a text."""
    parts = blast_radius(text, keywords), term_frequency(text, keywords), contextual_relevance(text, known_terms)
    score = weighted(*parts)
    names = ("blast_radius", "term_frequency", "contextual_relevance")
    return F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)], score.alias("score"), confidence_level(score).alias("confidence_level"), matching_keywords(text, keywords).alias("matching_keywords"))
