"""All queries of the engine and their SQL."""

from __future__ import annotations

from siftwright.plans import conversion, corpus, decisions, derived, evaluation, files, loops, ordering, records, relational, storage, streams
from siftwright.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for part in (corpus.CATALOG, evaluation.CATALOG, loops.CATALOG, files.CATALOG, conversion.CATALOG, storage.CATALOG, ordering.CATALOG, streams.CATALOG, derived.CATALOG, decisions.CATALOG, records.CATALOG, relational.CATALOG):
    QUERIES |= part.queries
    ORACLE_SQL |= part.sql
