"""Name -> query, name -> SQL. Query modules register themselves through ``query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from lodestone.plans import contents, context, deltas, graphs, health, indexing, parsing, projects, scoring, storage, streams, telemetry, texts, tools, usage, vectors  # noqa: E402, F401
