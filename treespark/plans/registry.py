"""A table of queries: a name, a function of the fixtures, and DuckDB SQL over the same fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, duck_sql


class Registry:
    def __init__(self):
        self.jobs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        """Decorator: registers f(fixtures) as query name."""

        def register(f: Callable[[Fixtures], DataFrame]):
            self.jobs[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
            if oracle:
                self.sql[name] = duck_sql(oracle)
            return f

        return register
