"""The registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from clausewise.plans import catalog_queries, kb_queries, packed_queries

MODULES = (packed_queries, kb_queries, catalog_queries)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
