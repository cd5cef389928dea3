"""Where queries are registered with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Registers a query; uses: names of fixtures that its SQL needs, separated by spaces."""

    def add(f: Query) -> Query:
        from .fixtures import SQL

        QUERIES[name] = f
        if sql:
            ORACLES[name] = ("WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in uses.split()) + "\n" if uses else "") + sql
        return f

    return add
