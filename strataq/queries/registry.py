"""Registered queries: name -> function (spark, folder) -> DataFrame, and SQL for the same rows."""

from __future__ import annotations

from strataq.session import Engine

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register f(engine) under a name."""
    def add(f):
        QUERIES[name] = lambda spark, folder: f(Engine(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def both(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that is SQL to us as well; `oracle` where the dialects differ."""
    query(name, oracle or sql)(lambda e: e.sql(sql))


def load_all() -> None:
    from strataq.queries import aggregates, graphs, rdf, relational, search, streams  # noqa: F401
