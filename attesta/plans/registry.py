"""Queries by name, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import Tables, tables

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


class Registry(dict[str, Query]):
    def query(self, sql: str | None) -> Callable:
        """Registers a function of the tables under its own name, with DuckDB SQL for the same rows (None: tested otherwise)."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self[f.__name__] = (lambda spark, sf_dir: f(tables(spark, sf_dir)), sql)
            return f

        return add
