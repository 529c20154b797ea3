"""Registry of runnable queries: each reads the standard tables and, where SQL can say the same, carries that SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """The standard tables of one folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def all(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under a name; ``covers`` lists the operators it exercises."""

    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} exists")
        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return register


def load_all() -> dict[str, Query]:
    from . import queries

    queries.load()
    return REGISTRY


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return load_all()[name].run(Tables(spark, folder))
