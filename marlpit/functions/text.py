"""Column functions on text: cleaning, tokens, paths, labels and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boilerplate that cleaning removes, in this order.
BOILERPLATE = (
    r"CARE Knowledge\s*Base",
    r"Knowledge Engine for CARE, by CARE!",
    r"Search by Category",
    r"All categories Search",
    r"Enter a search term.*",
    r"Recent Posts",
    r"All Articles.*",
    r"Select Category",
    r"Categories",
    "📝",
)
# Routes in the order of their priority, with the words that choose them.
ROUTES = (
    ("tracker_update", "smartsheet", 0.99, "Smartsheet tracker operation detected.", ("smartsheet", "tracker", "update tracker", "review status", "current state", "assign reviewer", "change state", "ready predv")),
    ("rollout_investigation", "datadog", 0.98, "Datadog log investigation detected.", ("datadog", "correlation id", "tracking id", "failure stage", "configurepropertyinfds", "logs", "rollout failed", "investigate rollout")),
    ("property_lookup", "sql", 0.95, "Property lookup detected.", ("property code", "client code", "hotel", "order number", "property 3174", "find property")),
)
NO_ROUTE = ("knowledge_search", "knowledge", 0.90, "General SOP / documentation query.")
# Document types by extension; MIME types by extension.
DOCUMENT_TYPES = {".pdf": "report", ".docx": "project", ".doc": "project", ".txt": "meeting_notes"}
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".xml": "text/xml",
    ".json": "application/json",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".zip": "application/zip",
}
UNKNOWN_MIME = "application/octet-stream"
#: Case-blind in all alphabets; only a newline ends what a dot matches.
FLAGS = "(?iud)"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(text: str | Column) -> Column:
    """Boilerplate removed, runs of blanks and of newlines made one, white space at the ends stripped."""
    bare = reduce(lambda t, form: F.regexp_replace(t, FLAGS + form, ""), BOILERPLATE, _column(text))
    single = F.regexp_replace(F.regexp_replace(bare, "[ \t]+", " "), "\n{2,}", "\n")
    return F.regexp_replace(single, r"(?U)\A\s+|\s+\z", "")


def tokens(text: str | Column) -> Column:
    """Lower-case words between white space, punctuation kept."""
    return F.filter(F.split(F.lower(_column(text)), r"(?U)\s+"), lambda x: x != "")


def n_tokens(text: str | Column) -> Column:
    """How many tokens a text has, counted without making them."""
    return F.regexp_count(_column(text), F.lit(r"(?U)\S+"))


def document_id(sequence: str | Column) -> Column:
    """DOC- and at least six digits; a sequence below 1 is an error."""
    number = _column(sequence)
    return F.when(number > 0, F.format_string("DOC-%06d", number)).otherwise(F.raise_error(F.lit("document sequence must be 1 or more")))


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def extension(path: str | Column) -> Column:
    """From the last dot of a path's name on, in lower case; empty without a dot. Dots that a name begins with don't count."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1))


def prefix(text: str | Column, length: int) -> Column:
    """The first characters of a text, all of a shorter one."""
    return F.substring(_column(text), 1, length)


def utc_stamp(moment: Column | None = None) -> Column:
    """A moment, by default that of the query, as text like 2024-02-29T12:00:00Z."""
    at = F.current_timestamp() if moment is None else moment
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def new_id() -> Column:
    """A random id for each row. Write the rows before they are read twice: each reading draws anew."""
    return F.uuid()


def _looked_up(key: Column, values: dict[str, str], default: str) -> Column:
    return reduce(lambda found, kv: F.when(key == kv[0], kv[1]).otherwise(found), reversed(values.items()), F.lit(default))


def document_type(path: str | Column) -> Column:
    return _looked_up(extension(path), DOCUMENT_TYPES, "other")


def mime_type(path: str | Column) -> Column:
    return _looked_up(extension(path), MIME_TYPES, UNKNOWN_MIME)


def route(query: str | Column) -> Column:
    """struct(intent, tool, confidence, reason): the first route with a word that is part of the query."""
    text = F.lower(_column(query))
    plan = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("intent", "tool", "confidence", "reason"), x, strict=True)])
    found = plan(NO_ROUTE)
    for *head, words in reversed(ROUTES):
        found = F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), plan(head)).otherwise(found)
    return found


def chat_label(score: str | Column) -> Column:
    value = _column(score)
    return F.when(value >= 0.08, "HIGH").when(value >= 0.03, "MEDIUM").otherwise("LOW")


def chip_colour(level: str | Column) -> Column:
    value = _column(level)
    return F.when(value >= 7, "success").when(value >= 5, "primary").otherwise("warning")
