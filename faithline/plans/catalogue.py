"""All queries over the reference's own operators."""

from . import dsl_queries, eval_queries, other_queries, task_queries, text_queries

_PARTS = (dsl_queries, text_queries, eval_queries, other_queries, task_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
