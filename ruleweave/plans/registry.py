"""Queries over the driver's tables, with the SQL each is compared with."""

from __future__ import annotations

from ruleweave.plans import answer_queries, compile_queries, data_queries, envelope_queries, export_queries, merge_queries, place_queries, rule_queries, selfcheck_queries, store_queries, table_queries, text_queries, view_queries

MODULES = (answer_queries, rule_queries, table_queries, text_queries, store_queries, data_queries, merge_queries, envelope_queries, compile_queries, export_queries, place_queries, view_queries, selfcheck_queries)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
FLAGSHIP = "batch_decisions"
