"""Registered queries: each applies operators to the test tables, with the same result in plain SQL where SQL can say it."""

from . import agreement_queries, dataset_queries, mining_queries, model_queries, page_queries, scalar_queries, score_queries, source_queries

_MODULES = (scalar_queries, source_queries, dataset_queries, score_queries, mining_queries, agreement_queries, model_queries, page_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
