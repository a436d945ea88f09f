"""Every query of the retrieval and scoring operators, by name, with the SQL that checks it."""

from __future__ import annotations

from marlpit.plans.oracle import ORACLE_SQL
from marlpit.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
