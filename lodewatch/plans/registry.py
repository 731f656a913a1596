"""Queries by name, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodewatch.plans.views import SQL as VIEW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def with_view(body: str, extra: str = "") -> str:
    """SQL over the unified view ``u`` and further tables."""
    return f"WITH {VIEW}{', ' + extra if extra else ''} {body}"
