"""All queries of the library, and their SQL."""

from __future__ import annotations

from halyard.plans import corpus_queries, event_queries, lexical_queries, trend_queries

_MODULES = (trend_queries, corpus_queries, lexical_queries, event_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "trend_primary"
