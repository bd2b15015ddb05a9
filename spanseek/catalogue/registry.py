"""A query is a function (tables) -> DataFrame with an optional SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanseek.session import ship, spread


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(ship(spark), folder))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def ctes(*parts: tuple[str, str], select: str) -> str:
    """A WITH clause; a body that begins with MATERIALIZED is computed once, however often it is used."""
    def one(name: str, body: str) -> str:
        plain = body.removeprefix("MATERIALIZED ")
        return f"{name} AS {'' if plain == body else 'MATERIALIZED '}({plain})"
    return "WITH " + ",\n".join(one(*p) for p in parts) + "\n" + select
