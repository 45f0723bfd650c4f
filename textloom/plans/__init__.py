"""Queries over the standard tables, and SQL with the same results."""

from . import coerced, scalars, shapes, statistics, tables, text  # noqa: F401 - they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
