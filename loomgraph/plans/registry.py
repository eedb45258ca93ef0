"""One name, one query: every module of queries registers its own through this."""

from __future__ import annotations

from collections.abc import Callable

_NAMES: dict[str, str] = {}


def registry(module: str) -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """A module's queries, their SQL, and the decorator that fills both; a name that exists, in any module, is an error."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            name = f.__name__
            if name in queries or _NAMES.setdefault(name, module) != module:
                raise ValueError(f"{module}: there is a query {name} in {_NAMES[name]}")
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, query
