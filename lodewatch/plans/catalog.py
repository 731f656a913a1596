"""All queries of the library."""

from lodewatch.plans import endpoint, files, lookups, queries, streams, threats  # noqa: F401
from lodewatch.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
