"""Table semantics: coercion, dedupe, merge, insert-ignore, upsert, metadata lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import finite, utc_timestamp
from .chunks import KEY

CORE_COLUMNS = ("temp", "humidity", "pressure", "rain_flag")


def coerce(df: DataFrame, numeric: Sequence[str], required: Sequence[str] = CORE_COLUMNS, ts: str = "timestamp") -> DataFrame:
    """Text columns to UTC time and finite doubles; rows lacking a required value are dropped.

    Header lines repeated inside a file fall out as unreadable times.
    """
    cols = {ts: utc_timestamp(F.col(ts)) if dict(df.dtypes)[ts] == "string" else F.col(ts)}
    cols |= {c: finite(F.trim(F.col(c).cast("string")).try_cast("double")) for c in numeric if c in df.columns}
    df = df.withColumns(cols)
    return df.dropna(subset=[ts, *required])


def with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Create absent optional columns as null doubles."""
    absent = {c: F.lit(None).cast("double") for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key (a combinable aggregate, no sort)."""
    return _pick(df, key, F.max_by, order)


def first_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return _pick(df, key, F.min_by, order)


def _pick(df: DataFrame, key: Sequence[str], fn, order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(fn(F.struct(*rest), F.struct(*order)).alias("_r"))
    return out.select(*[c if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def merge_history(*frames: DataFrame, key: Sequence[str] = (KEY, "ts"), order: str | None = None) -> DataFrame:
    """Union of histories where, per key, the later frame and then the later row wins."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    union = ranked[0]
    for f in ranked[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    by = [F.col("_rank"), *([F.col(order)] if order else [])]
    return latest_by_key(union, list(key), by).drop("_rank")


def insert_ignore(existing: DataFrame, batch: DataFrame, key: Sequence[str], arrival: str) -> DataFrame:
    """Rows of ``batch`` to append: keys not stored yet, the first arrival of each."""
    fresh = batch.join(existing.select(*key), list(key), "left_anti")
    return first_by_key(fresh, list(key), [F.col(arrival)])


def upsert(existing: DataFrame, changes: DataFrame, key: Sequence[str], arrival: str) -> DataFrame:
    """Table after replacing rows by key; the last change wins."""
    old = existing.withColumn("_new", F.lit(0))
    new = changes.withColumn("_new", F.lit(1))
    union = old.unionByName(new, allowMissingColumns=True)
    return latest_by_key(union, list(key), [F.col("_new"), F.col(arrival)]).drop("_new")


def time_range(df: DataFrame, ts: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows with start <= ts < end; an absent bound is open.  The comparison reaches the scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) < end)
    return df


def with_metadata(rows: DataFrame, by_lead: DataFrame, by_source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach forecast provenance: the (source, lead) entry if there is one, else the source's."""
    a = by_lead.select("source_layer", "lead_minutes", F.struct(*columns).alias("_a"))
    b = by_source.select("source_layer", F.struct(*columns).alias("_b"))
    df = rows.join(a, ["source_layer", "lead_minutes"], "left").join(b, "source_layer", "left")
    return df.withColumns({c: F.coalesce(F.col("_a"), F.col("_b"))[c] for c in columns}).drop("_a", "_b")
