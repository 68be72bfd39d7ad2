"""A register of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.session import spread, table


#: Tables whose rows are dear to work on.
TEXTS = ("documents", "pages")


class Tables:
    """Input tables of one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = table(self.spark, self.sf_dir, name)
        return spread(df) if name in TEXTS else df


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Registers a function of ``Tables`` under ``name``."""

        def keep(make: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return make

        return keep
