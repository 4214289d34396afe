"""Queries by name, each with the SQL that gives the same rows (None where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

found: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def put(f: Callable) -> Callable:
        found[f.__name__] = (f, sql)
        return f

    return put
