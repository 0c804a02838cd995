"""The queries over the supplied tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, with SQL where it can express them. Those put aside run over a few texts in code, not over tables:
    they are for tests only."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.aside: set[str] = set()

    def registered(self) -> list[str]:
        return [name for name in self.queries if name not in self.aside]

    def add(self, sql: str | None = None, aside: bool = False) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if aside:
                self.aside.add(f.__name__)
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
