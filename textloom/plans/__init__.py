"""The registered queries."""

from textloom.plans import compose_queries, form_queries, record_queries, rollup_queries, search_queries, table_queries, version_queries  # noqa: F401
from textloom.plans.registry import QUERIES, by_category, find, query, run, select

__all__ = ["QUERIES", "by_category", "find", "query", "run", "select"]
