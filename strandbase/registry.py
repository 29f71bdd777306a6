"""One entry for each operator query: the Spark side and, where SQL can say it, the DuckDB side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its SQL names the same columns."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import all modules that register queries."""
    from . import operators, sources, streaming  # noqa: F401
    from .operators import detect, dictionary, entropy, integers, match, metrics, select, structure  # noqa: F401
    from .sources import archives, framing, tables  # noqa: F401
    from .streaming import events  # noqa: F401
