"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; `covers` lists the inventory rows it shows."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        name = run.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} exists")
        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, so that a different order of addition gives the same figures."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
