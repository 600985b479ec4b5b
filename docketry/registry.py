"""Registered queries: name, callable and, where SQL can say it, the same query as SQL over the Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracle: dict[str, str] = field(default_factory=dict)
    operators: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def add(self, name: str, *operators: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under ``name``; ``operators`` are the ids of the operator inventory it covers."""

        def register(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = run
            self.operators[name] = operators
            if sql is not None:
                self.oracle[name] = sql
            return run

        return register


CORE = Registry()
