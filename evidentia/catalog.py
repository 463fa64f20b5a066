"""All registered queries: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from .plans import carry_queries, change_queries, clone_queries, contract_queries, flow_queries, graph_queries, policy_queries, refresh_queries, resolve_queries, search_queries, source_queries, span_queries, table_queries

_PLANS = (carry_queries, refresh_queries, clone_queries, search_queries, span_queries, resolve_queries, graph_queries, table_queries, policy_queries, change_queries, flow_queries, contract_queries, source_queries)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
