"""Every query of the engine beside its SQL twin; None marks a query that SQL cannot express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_entries: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in _entries:
            raise ValueError(f"{name} is registered twice")
        _entries[name] = (query, sql)
        return query

    return add


def entries() -> dict[str, tuple[Query, str | None]]:
    return dict(_entries)
