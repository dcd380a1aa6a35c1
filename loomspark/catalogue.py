"""All registered queries: one module of ``plans`` for each area, merged here."""

from __future__ import annotations

from .plans import graph_queries, mapping_queries, relational_queries, temporal_queries, training_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (relational_queries, temporal_queries, graph_queries, mapping_queries, training_queries):
    QUERIES |= _module.area.queries
    ORACLE_SQL |= _module.area.sql
