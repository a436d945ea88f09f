"""Language identification by Bayesian fusion of evidence about web pages.

The text's likelihood comes from hashed character trigrams, counted over all labelled documents. Three more pieces of
evidence come from grouped counts over all pages of what the text alone says: the declared markup language and the
address suffix, each by how often it goes with a language, and the host, whose prior is smoothed towards that of its
domain, and that towards the one of all pages. A page's own count is taken out of its host's and domain's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import text_or_empty, written

#: Trigrams are hashed to so many numbers.
TRIGRAMS = 1 << 14
#: What trigrams of one page say is in part the same. n of them count as n INDEPENDENT / (n + INDEPENDENT) independent ones,
#: at every n: nearly all of a few, and of however many no more than this number.
INDEPENDENT = 400
#: Pseudo-counts: of a trigram, of evidence given a language, of the wider prior at a host or domain.
TRIGRAM_ALPHA, EVIDENCE_ALPHA, PRIOR_ALPHA = 0.5, 1.0, 5.0
# Elements whose content is no text of a page, and those that hold it.
FRAMES = r"script|style|nav|header|footer|aside|noscript|template|title"
SILENT = re.compile(rf"<(?P<name>{FRAMES})\b[^>]*>|(?P<comment><!--)|(?P<ad><div class=\"ad\">)", re.IGNORECASE)
ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in FRAMES.split("|")} | {"comment": re.compile("-->"), "ad": re.compile("</div>", re.IGNORECASE)}
CODE = ("script", "style")
ARTICLE, TAG = re.compile(r"<(/?)(article|main)\b[^>]*>", re.IGNORECASE), re.compile(r"<[^>]*>")
OTHER = "other"


def without_frame(markup: str) -> str:
    """The markup without elements that hold no text. Of one that never ends only the tag goes; code runs to the end."""
    out, at, endless = [], 0, set()
    while found := SILENT.search(markup, at):
        name = (found["name"] or found.lastgroup).lower()
        end = None if name in endless else ENDS[name].search(markup, found.end())
        if not end:
            if name in CODE:
                return "".join([*out, markup[at : found.start()]])
            endless.add(name)
        out += [markup[at : found.start()], " "]
        at = (end or found).end()
    return "".join(out) + markup[at:]


def plain_text(markup: str) -> str:
    return " ".join(html.unescape(TAG.sub(" ", markup)).split())


def page_text(markup: str) -> str:
    """The text of a page's outermost articles, or of the whole page without its frame if they have none."""
    silent = without_frame(markup)
    parts, open_tags, start = [], [], 0
    for found in ARTICLE.finditer(silent):
        name = found[2].lower()
        if not found[1]:
            if not open_tags:
                start = found.end()
            open_tags.append(name)
        elif name in open_tags:  # an end tag ends what was left open within its element too
            while open_tags.pop() != name:
                pass
            if not open_tags:
                parts.append(silent[start : found.start()])
    if open_tags:
        parts.append(silent[start:])
    return plain_text(" ".join(parts)) or plain_text(silent)


def trigrams(text: str) -> np.ndarray:
    """The hashed character trigrams of a text in lower case, a space at each end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # languages x trigrams

    def log_likelihoods(self, text: str) -> np.ndarray:
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.languages))
        return self.logs[:, found].sum(1) * (INDEPENDENT / (len(found) + INDEPENDENT))


def fit_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Trigram counts by language over all documents that name one, summed by Spark; the model has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums.setdefault(language, np.zeros(TRIGRAMS, np.int64))
                sums[language] += np.bincount(trigrams(text), minlength=TRIGRAMS)
        for language, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([language] * len(seen), pa.string()), "gram": pa.array(seen), "n": pa.array(total[seen])})

    own = docs.select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text")).filter("lang is not null")
    counts = own.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_language = counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).collect()
    languages = sorted(row.lang for row in by_language)
    totals = np.zeros((len(languages), TRIGRAMS))
    for row in by_language:
        for gram, n in row.grams:
            totals[languages.index(row.lang), gram] = n
    return TextModel(languages, np.log((totals + TRIGRAM_ALPHA) / (totals + TRIGRAM_ALPHA).sum(1, keepdims=True)))


def described(pages: DataFrame, model: TextModel, url_col: str, html_col: str, id_col: str) -> DataFrame:
    """(id, logs, text_lang, declared, suffix, host, domain) of pages; logs by language in the model's order."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [shared.value.log_likelihoods(page_text(x)) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in ("id", "declared", "suffix", "host", "domain")} | {"logs": pa.array([x.tolist() for x in logs], pa.list_(pa.float64()))})

    known = lambda found: F.when(found.isin(model.languages), found).otherwise(F.lit(OTHER))
    markup, url = text_or_empty(html_col), F.lower(text_or_empty(url_col))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    own = pages.select(
        F.col(id_col).alias("id"),
        markup.alias("html"),
        known(F.lower(F.regexp_extract(markup, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))).alias("declared"),
        F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
    )
    kind = pages.schema[id_col].dataType.simpleString()
    found = own.mapInArrow(read, f"id {kind}, declared string, suffix string, host string, domain string, logs array<double>")
    best = F.array_position("logs", F.array_max("logs")).cast("int")
    languages = F.array(*[F.lit(x) for x in model.languages])
    return found.withColumn("text_lang", F.when(F.array_max("logs") != F.array_min("logs"), F.element_at(languages, best)))


def counted(rows: DataFrame, by: str, languages: list[str]) -> DataFrame:
    """(by, by_n): how many pages of each value the text puts in each language, in order."""
    return rows.groupBy(by).agg(F.array(*[F.count_if(F.col("text_lang") == x).cast("double") for x in languages]).alias(f"{by}_n"))


def likelihood(column: str, at: int, totals: list[int], values: int) -> Column:
    """log P(value | language) of smoothed counts."""
    return F.log((F.get(f"{column}_n", F.lit(at)) + EVIDENCE_ALPHA) / F.lit(totals[at] + EVIDENCE_ALPHA * values))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, confidence, text_lang, declared, suffix, host) of every page.

    A page without text is judged by the other evidence. Null or unreadable addresses share an empty host and suffix,
    an absent or unknown declaration counts as `other`. Ties go to the first language by name. Without labelled
    documents lang is null and confidence 0. Null ids stay null; repeated rows give repeated rows; other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    model = fit_text(docs, text_col, lang_col)
    languages = model.languages
    kind = pages.schema[id_col].dataType
    if not languages:
        absent = F.lit(None).cast("string")
        return pages.select(F.col(id_col).cast(kind), absent.alias("lang"), F.lit(0.0).alias("confidence"), absent.alias("text_lang"), absent.alias("declared"), absent.alias("suffix"), absent.alias("host"))
    rows = written(described(pages, model, url_col, html_col, id_col))
    totals = rows.agg(*[F.count_if(F.col("text_lang") == x) for x in languages]).first()
    values = {by: rows.select(by).distinct().count() for by in ("declared", "suffix")}
    found = rows
    for by in ("declared", "suffix", "domain", "host"):
        found = found.join(counted(rows, by, languages), by)
    base = [(n + 1.0) / (sum(totals) + len(languages)) for n in totals]
    scores = []
    for at, language in enumerate(languages):
        own = F.coalesce((F.col("text_lang") == language).cast("double"), F.lit(0.0))
        seen = lambda by: F.get(f"{by}_n", F.lit(at)) - own  # noqa: B023, E731
        size = lambda by: F.aggregate(f"{by}_n", F.lit(0.0), lambda a, b: a + b) - F.col("text_lang").isNotNull().cast("double")
        domain = (seen("domain") + PRIOR_ALPHA * base[at]) / (size("domain") + PRIOR_ALPHA)
        prior = (seen("host") + PRIOR_ALPHA * domain) / (size("host") + PRIOR_ALPHA)
        scores.append(F.get("logs", F.lit(at)) + likelihood("declared", at, totals, values["declared"]) + likelihood("suffix", at, totals, values["suffix"]) + F.log(prior))
    found = found.withColumn("scores", F.array(*scores)).withColumn("top", F.array_max("scores"))
    sure = 1.0 / F.aggregate(F.transform("scores", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    lang = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("scores", F.col("top")).cast("int"))
    return found.select(F.col("id").alias(id_col), lang.alias("lang"), sure.alias("confidence"), "text_lang", "declared", "suffix", "host")
