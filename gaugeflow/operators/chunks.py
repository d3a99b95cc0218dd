"""Time chunks: how every window in this package stays parallel within one station.

A station may hold a third of all rows, so ``partitionBy("station_id")`` would
put that third into one task.  Two tools avoid it.

*Halo chunks* (:func:`spread`, :func:`spread_rows`): cut each station into
chunks and copy the few rows next to a boundary into the neighbouring chunk.
A window with a bounded reach, partitioned by (station, chunk), then sees all
it needs; :func:`core_only` drops the copies.  One shuffle serves every window.

*Carries* (:func:`carry`, :func:`running_total`, :func:`ordinal`): for
unbounded running values, aggregate each chunk to one row, scan those few rows
per station, and join the carried-in value back on (station, chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import DAY, SECOND

CHUNK = "_chunk"
CORE = "_core"
US = "_us"
KEY = "station_id"


def micros(seconds: float) -> int:
    return int(round(seconds * SECOND))


def bucket(us: Column, width: int) -> Column:
    """Floor division of epoch micros (also right before 1970)."""
    return F.floor(us / F.lit(float(width))).cast("long")


def spread(df: DataFrame, before: float, after: float, span: int = DAY, ts: str = "ts") -> DataFrame:
    """Add ``_us``, ``_chunk`` and ``_core``, copying rows into chunks whose halo covers them.

    ``before``/``after`` are the seconds of context a chunk needs on each side.
    """
    us = refused(df, ts, F.unix_micros(F.col(ts)))
    lo = bucket(F.col(US) - F.lit(micros(after)), span)
    hi = bucket(F.col(US) + F.lit(micros(before)), span)
    return (
        df.withColumn(US, us)
        .withColumn(CHUNK, F.explode(F.sequence(lo, hi)))
        .withColumn(CORE, F.col(CHUNK) == bucket(F.col(US), span))
    )


def spread_rows(df: DataFrame, before: int, after: int, number: str, per_chunk: int = 50_000) -> DataFrame:
    """Like :func:`spread`, for windows whose reach is a row count at unbounded time distance.

    ``number`` is a per-station row number (see :func:`ordinal`).
    """
    n = F.col(number)
    k = float(per_chunk)
    return df.withColumn(
        CHUNK, F.explode(F.sequence(F.floor((n - after) / k), F.floor((n + before) / k)))
    ).withColumn(CORE, F.col(CHUNK) == F.floor(n / k))


def core_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(CORE)


def refused(df: DataFrame, ts: str, value: Column) -> Column:
    """``value``, or an error for a row without time or station: joins on chunks would lose it."""
    missing = F.col(ts).isNull() | F.col(KEY).isNull() if KEY in df.columns else F.col(ts).isNull()
    return F.when(missing, F.raise_error(F.lit("a row lacks its station or time")).cast("long")).otherwise(value)


def with_chunk(df: DataFrame, span: int = DAY, ts: str = "ts") -> DataFrame:
    return df.withColumn(CHUNK, refused(df, ts, bucket(F.unix_micros(F.col(ts)), span)))


def carry(
    df: DataFrame,
    by: Sequence[str],
    summary: Sequence[Column],
    carried: dict[str, Callable],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Join to each row the values carried in from all earlier chunks of its key.

    ``summary`` aggregates one chunk; ``carried`` maps an output name to a
    function of the window over chunk rows (ordered by chunk) giving the
    carried column.  The chunk table has one row per (key, chunk).
    """
    keys = [*by, CHUNK]
    w = Window.partitionBy(*by).orderBy(CHUNK)
    marks = df.groupBy(*keys).agg(*summary)
    marks = marks.select(*keys, *[make(w).alias(name) for name, make in carried.items()], *extra)
    return df.join(marks, keys)


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over ``by`` in ``order``; needs ``_chunk`` ordered with ``order``."""
    df = df.withColumns({f"_{out}_v": value.cast("long") for out, value in values.items()})

    def before(out: str):
        return lambda w: F.coalesce(F.sum(f"_{out}_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    df = carry(
        df, by, [F.sum(f"_{out}_v").alias(f"_{out}_s") for out in values], {f"_{out}_base": before(out) for out in values})
    w = Window.partitionBy(*by, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({out: F.col(f"_{out}_base") + F.sum(f"_{out}_v").over(w) for out in values})
    return df.drop(*[f"_{out}_{x}" for out in values for x in ("v", "base")])


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    return running_totals(df, by, order, {out: value})


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based row number over ``by`` in ``order`` without one task per key; needs ``_chunk``."""
    base = f"_{out}_base"
    df = carry(
        df,
        by,
        [F.count(F.lit(1)).alias("_n")],
        {base: lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))},
    )
    w = Window.partitionBy(*by, CHUNK).orderBy(*order)
    return df.withColumn(out, F.col(base) + F.row_number().over(w)).drop(base)


def cut_points(df: DataFrame, by: Sequence[str], order: Sequence[str], ranks: dict[str, Callable]) -> DataFrame:
    """Per key the row count ``_total`` and, per named rank, the order struct of the row at that 0-based rank.

    ``ranks`` maps a name to a function of the total count.  Chunks are counted
    first; only the chunks holding a wanted rank are then sorted.  The result
    has one row per key, so wide rows can be split by comparing their order
    columns with it instead of being numbered.
    """
    by = list(by)
    keys = with_chunk(df.select(*by, *order), ts=order[0])
    w = Window.partitionBy(*by)
    counts = keys.groupBy(*by, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({
        "_total": F.sum("_n").over(w),
        "_base": F.sum("_n").over(w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
    })
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), make(F.col("_total")).cast("long").alias("rank")) for name, make in ranks.items()])
    spots = counts.withColumn("_w", F.explode(wanted)).select(
        *by, CHUNK, "_total", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_base")).alias("_k"), "_n"
    ).filter((F.col("_k") >= 0) & (F.col("_k") < F.col("_n")))
    number = F.row_number().over(Window.partitionBy(*by, CHUNK, "_name").orderBy(*order)) - 1
    hit = keys.join(spots, [*by, CHUNK]).withColumn("_i", number).filter(F.col("_i") == F.col("_k"))
    found = hit.groupBy(*by).agg(*[
        F.max(F.when(F.col("_name") == name, F.struct(*order))).alias(name) for name in ranks])
    totals = counts.groupBy(*by).agg(F.max("_total").alias("_total"))
    return totals.join(found, by, "left")
