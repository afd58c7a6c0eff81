"""All queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from corpusmill.plans import queries_retrieval, queries_rules, queries_text, queries_verify

_MODULES = (queries_retrieval, queries_text, queries_rules, queries_verify)

QUERIES = {name: f for m in _MODULES for name, f in m.query.queries.items()}
SQL = {name: s for m in _MODULES for name, s in m.query.sql.items()}
