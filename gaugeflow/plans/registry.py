"""Query registry: name -> (Spark plan, optional DuckDB twin)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import rounded


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register a plan; ``oracle`` is plain DuckDB SQL over the driver's tables."""

    def register(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        build.__name__ = name
        QUERIES[name] = Query(build, oracle)
        return fn

    return register


def rd(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return rounded(col.cast("double"), digits) + F.lit(0.0)


def ts_us(name: str) -> Column:
    return F.unix_micros(F.col(name)).alias(f"{name}_us")


def sql_rd(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(cast({expr} as double), {digits}) + 0.0 as {alias}"
