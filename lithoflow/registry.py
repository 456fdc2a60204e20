"""The queries of the library by name, and the SQL each is checked against."""

from __future__ import annotations

from .plans import answer_queries, document_queries, interval_queries, reading_queries, retrieval_queries, search_queries, unit_queries, well_queries

_MODULES = [unit_queries, reading_queries, interval_queries, well_queries, document_queries, search_queries, retrieval_queries, answer_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
