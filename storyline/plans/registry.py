"""All queries of the library and their SQL."""

from __future__ import annotations

from storyline.plans import check_queries, cluster_queries, desk_queries, event_queries, ledger_queries, order_queries, registry_queries, source_queries, story_queries, text_queries

AREAS = (event_queries, order_queries, text_queries, source_queries, desk_queries, story_queries, cluster_queries, check_queries, ledger_queries, registry_queries)
QUERIES = {name: f for area in AREAS for name, f in area.QUERIES.items()}
ORACLE_SQL = {name: sql for area in AREAS for name, sql in area.ORACLE_SQL.items()}
