"""Training-data operators: each module holds one operator over DataFrames.

`queries()` and `oracle_sql()` hand the registered queries to the entry module.
Nothing outside this package imports it.
"""

from corpusflow.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
