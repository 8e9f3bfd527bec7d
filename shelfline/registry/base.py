"""Collects queries together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfline.bindings import ctes
from shelfline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            assert name not in self.queries, name

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return fn(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                text = sql.strip()
                if views:
                    head = ctes(*views).rstrip()
                    # a query that starts with its own WITH continues the list of views
                    text = f"{head},\n{text[5:]}" if text.upper().startswith("WITH ") else f"{head}\n{text}"
                self.oracles[name] = text
            return fn

        return add
