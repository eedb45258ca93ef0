"""All queries of the engine's own operators, and the SQL of those that SQL can express."""

from . import code_queries, graph_queries, knowledge_queries, log_queries, module_queries, text_queries, view_queries

_PARTS = (graph_queries, text_queries, log_queries, view_queries, knowledge_queries, module_queries, code_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
SQL["architecture_report"] = graph_queries.report_sql()
