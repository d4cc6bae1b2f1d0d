"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, sql_of: dict[str, str]) -> Callable:
    """A decorator maker: @query(sql) adds a function, and its SQL if it can be said in SQL."""

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                sql_of[f.__name__] = sql
            return f

        return add

    return query
