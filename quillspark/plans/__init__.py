"""Named queries of the engine and their SQL oracles."""

from quillspark.plans import rank_queries, source_queries, table_queries, text_queries  # noqa: F401
from quillspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
