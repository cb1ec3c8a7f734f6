"""Name to query and name to DuckDB SQL, filled by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator that files a query under a name, with its SQL where there is one."""

    def keep(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return query

    return keep
