"""A query is a named DataFrame builder with an optional DuckDB twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ("reports", "texts", "matching", "graphs", "pages", "crawls", "writes", "streams", "rebuilds", "routes")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Catalog(dict):
    """``@catalog("name", sql)`` registers a builder."""

    def __call__(self, name: str, sql: str | None = None):
        def keep(run):
            self[name] = Query(run, sql)
            return run

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collected() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found |= importlib.import_module(f"quarrylight.plans.{module}").catalog
    return found
