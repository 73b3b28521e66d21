"""Queries by name, and the SQL that gives the same rows."""

from . import feed_queries, key_queries, object_queries, range_queries, rule_queries, stream_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
