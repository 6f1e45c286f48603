"""Registered queries: a Spark callable, and the check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.catalog.tables import check_sql, load
from rankloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = load(self.spark, self.sf_dir, name)
        setattr(self, name, table)
        return table


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its check SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return fn

    return register


def half_up(expression: str, digits: int) -> str:
    """SQL counterpart of ``functions.numbers.rounded``."""
    return f"CAST(round(CAST({expression} AS DECIMAL(18,6)), {digits}) AS DOUBLE)"
