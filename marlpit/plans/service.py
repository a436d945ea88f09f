"""A request and its response, as a caller without Spark would use them."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.operators import processing

#: A response never has more results, whatever the request's limit.
MOST_RESULTS = 5


@dataclass(frozen=True)
class QueryRequest:
    query: str
    team_id: str | None = None
    doc_type: str | None = None
    limit: int = 10

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be from 1 to 100")


@dataclass(frozen=True)
class QueryResponse:
    query: str
    total_results: int
    execution_time_ms: float
    results: list[dict] = field(default_factory=list)


def health() -> dict[str, str]:
    return {"status": "healthy", "timestamp": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}


def query_documents(documents: DataFrame, request: QueryRequest) -> QueryResponse:
    """The best documents (document_id, text, and team_owner or document_type if the request names one) by score.

    Team and type are real filters here.
    """
    began = time.perf_counter()
    for column, wanted in (("team_owner", request.team_id), ("document_type", request.doc_type)):
        if wanted is not None:
            documents = documents.filter(F.col(column) == wanted)
    kind, title = ("document_type" if "document_type" in documents.columns else None), ("title" if "title" in documents.columns else "document_id")
    found = processing.query_documents(documents, request.query, min(request.limit, MOST_RESULTS), ["document_id"], title, kind=kind)
    rows = [r.asDict() | {"confidence": r.confidence_level / 10.0} for r in found.collect()]
    return QueryResponse(request.query, len(rows), 1000 * (time.perf_counter() - began), rows)
