"""States of days: what each day contributes to a result, stored once and merged with those of other days.

Summaries, scores, forecast errors and feature values are sums, extremes or
counts. A day's are stored in a folder of its own; a new day is one more folder
and a corrected one replaces its folder, so a result over all history reads
small states of every day but the rows of the new day alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "state_date"


def day_of(ts: str | Column, offset_hours: int = 0) -> Column:
    """The date of a time in UTC, or in a zone that many hours ahead."""
    us = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.to_date(F.timestamp_micros(us + offset_hours * 3_600_000_000))


def add_days(rows: DataFrame, folder: str, date: Column, state: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    """Store the states of the dates in ``rows``, which are all rows of these dates.

    ``state`` makes the states of some rows, with the given columns among those
    it groups by. Dates already stored are replaced, others stay; doing it again
    changes nothing. Rows without a date count for no day.
    """
    dated = rows.withColumn(DATE, date).filter(F.col(DATE).isNotNull())
    states = state(dated, [DATE])
    states.hint("rebalance", DATE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(folder)


def states(spark: SparkSession, folder: str, first: str | None = None, before: str | None = None) -> DataFrame:
    """Stored states from date ``first`` up to, but without, date ``before``; only their folders are read."""
    found = spark.read.option("basePath", folder).parquet(folder)
    if first:
        found = found.filter(F.col(DATE) >= F.lit(first).cast("date"))
    return found.filter(F.col(DATE) < F.lit(before).cast("date")) if before else found
