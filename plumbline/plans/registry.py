"""The engine's queries by name, and the same results in SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name with its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put
