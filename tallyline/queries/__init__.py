"""The registry of core queries: name -> function of (spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function under ``name``, with its SQL where there is one."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


from . import files, library, more, rollups, scoring, selections, statistics, streams  # noqa: E402, F401
