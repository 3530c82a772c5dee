"""Where queries and their SQL twins are kept."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Register a query; ``tables`` are the WITH parts its SQL needs."""
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = ("WITH " + ",\n".join(tables) + "\n" if tables else "") + sql
        return build
    return keep
