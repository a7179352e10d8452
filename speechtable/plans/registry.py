"""Queries by name."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(query: Callable) -> Callable:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return put
