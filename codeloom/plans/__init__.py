"""Operators bound to the test tables."""

from . import graph_queries, inspect_queries, source_queries, store_queries, table_queries, text_queries, tool_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
