"""The register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FUNCTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers fn(tables) under a name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        FUNCTIONS[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return fn

    return register


def money(column: str, digits: int = 2) -> Column:
    """A double as exact money, so that sums don't depend on their order."""
    return F.col(column).cast(f"decimal(18,{digits})")
