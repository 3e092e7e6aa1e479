"""How queries are registered, each with its SQL twin where SQL can express it."""

from __future__ import annotations


def registrar(queries: dict, oracle: dict[str, str]):
    """A decorator that registers a query, with its SQL twin where it has one."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query
