"""Every registered query with its DuckDB oracle, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def add(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"{name} is registered twice")
        _ENTRIES[name] = Entry(run, sql)
        return run

    return add


def _load() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"loomgraph.plans.{module}")


MODULES: tuple[str, ...] = ("q_listing", "q_search", "q_graph", "q_resolve", "q_text", "q_render", "q_source", "q_stream")


def queries() -> dict[str, Query]:
    _load()
    return {k: e.run for k, e in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.sql for k, e in _ENTRIES.items() if e.sql}
