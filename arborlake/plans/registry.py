"""Collects queries and their oracles as the query modules are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.sources.project import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *uses: str) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its oracle over the projections it ``uses`` (None: rows only)."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, *uses) if uses else sql
        return f

    return register
