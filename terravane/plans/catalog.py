"""All queries by name, with the SQL that gives the same rows where there is any."""

from . import crm_queries, evaluation_queries, file_queries, fold_queries, history_queries, index_queries, lead_queries, nested_queries, place_queries, rule_queries

MODULES = [lead_queries, history_queries, evaluation_queries, place_queries, rule_queries, crm_queries, fold_queries, nested_queries, file_queries, index_queries]
QUERIES = {name: pair[0] for m in MODULES for name, pair in m.QUERIES.items()}
ORACLE_SQL = {name: pair[1] for m in MODULES for name, pair in m.QUERIES.items() if pair[1]}
