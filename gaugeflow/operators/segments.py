"""Series repair and segmentation (bursts, short gaps, segment ids, tails)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..policy import DAY, Cadence, FEATURE_GAPS, GapRule, LiveRule
from .chunks import CHUNK, CORE, KEY, US, bucket, core_only, micros, running_total, spread

FILLED = "observation_gap_filled"
TAIL = "simulation_tail_filled"
SEG = "_seg"
_CONSERVATIVE = ("rain_flag", "rain_sensor")


def _chunk_window() -> Window:
    return Window.partitionBy(KEY, CHUNK).orderBy(US)


def drop_bursts(df: DataFrame, cadence: Cadence = Cadence()) -> DataFrame:
    """Of readings following each other within the burst limit keep the newest (``df`` is spread)."""
    nxt = F.lead(US).over(_chunk_window())
    return df.withColumn("_nxt", nxt).filter(
        F.col("_nxt").isNull() | (F.col("_nxt") - F.col(US) > micros(cadence.burst_max))
    ).drop("_nxt")


def mark_segments(df: DataFrame, rule: GapRule = FEATURE_GAPS) -> DataFrame:
    """Add ``_start`` and the chunk-local ``_seg`` number to a spread frame.

    A row with no predecessor inside the halo counts as a start: either the
    gap exceeds the rule or it is the first row of the station.
    """
    w = _chunk_window()
    gap = F.col(US) - F.lag(US).over(w)
    start = gap.isNull() | (gap < micros(rule.low)) | (gap > micros(rule.high))
    df = df.withColumn("_start", start.cast("int"))
    return df.withColumn(SEG, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _blend(name: str, dtype: T.DataType, numeric: bool) -> Column:
    """Value of one column on slot k between a row and its successor."""
    left, right = F.col(name), F.col(f"_next.{name}")
    if name in _CONSERVATIVE:
        inside = F.greatest(left, right)
    elif name == "rain" and isinstance(dtype, T.BooleanType):
        inside = F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))
    elif numeric:
        inside = F.coalesce(left + (right - left) * F.col("_frac"), left, right)
    else:
        inside = F.coalesce(left, right)
    return F.when(F.col("_slot") == 0, left).otherwise(inside).alias(name)


def fill_short_gaps(
    df: DataFrame, cadence: Cadence = Cadence(), span: int = DAY, keep: Sequence[str] = ()
) -> DataFrame:
    """Insert one interpolated row per missing minute (``df`` is spread and burst-free).

    The fill is a generator over slots 0..n of each row, so it adds no union
    and no shuffle.  ``keep`` names columns copied from the left row.
    """
    bookkeeping = {KEY, "ts", US, CHUNK, CORE, SEG, FILLED, "_start", *keep}
    payload = [f for f in df.schema.fields if f.name not in bookkeeping]
    if FILLED not in df.columns:
        df = df.withColumn(FILLED, F.lit(0.0))
    following = F.lead(F.struct(F.col(US).alias("us"), *[F.col(f.name) for f in payload])).over(_chunk_window())
    gap = F.col("_next.us") - F.col(US)
    fillable = (gap > micros(cadence.fill_over)) & (gap <= micros(cadence.fill_upto))
    missing = F.greatest(F.lit(1), F.bround(gap / float(micros(cadence.nominal)), 0).cast("int") - 1)
    df = (
        df.withColumn("_next", following)
        .withColumn("_gap", gap)
        .withColumn("_n", F.when(fillable, missing).otherwise(0))
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        .withColumn("_frac", F.col("_slot") / (F.col("_n") + 1))
    )
    moved = F.expr(f"{US} + (_gap * _slot) div (_n + 1)")
    us = F.when(F.col("_slot") == 0, F.col(US)).otherwise(moved)
    is_numeric = [isinstance(f.dataType, T.NumericType) for f in payload]
    out = df.select(
        KEY, CHUNK, us.alias(US),
        *[c for c in (SEG, *keep) if c in df.columns],
        *[_blend(f.name, f.dataType, num) for f, num in zip(payload, is_numeric)],
        F.when(F.col("_slot") > 0, 1.0).otherwise(F.coalesce(F.col(FILLED), F.lit(0.0))).alias(FILLED),
        *([F.when(F.col("_slot") > 0, 0).otherwise(F.col("_start")).alias("_start")] if "_start" in df.columns else []),
    )
    return out.withColumn("ts", F.timestamp_micros(F.col(US))).withColumn(
        CORE, F.col(CHUNK) == bucket(F.col(US), span)
    )


def repaired_chunks(
    df: DataFrame, before: float = 0.0, after: float = 0.0,
    cadence: Cadence = Cadence(), rule: GapRule = FEATURE_GAPS, span: int = DAY,
) -> DataFrame:
    """Spread, de-burst, segment and gap-fill in one shuffle.

    ``before``/``after`` is the context later windows need; the repair itself
    adds the reach of one fillable gap and of one burst.
    """
    reach = max(cadence.fill_upto, rule.high)
    # Asked for by name: rows that come dealt by station (as a join may leave them) would satisfy the windows and keep a station in one task.
    df = spread(df, before + reach, after + reach + cadence.burst_max, span).repartition(KEY, CHUNK)
    df = mark_segments(drop_bursts(df, cadence), rule)
    return fill_short_gaps(df, cadence, span)


def collapse_bursts(df: DataFrame, cadence: Cadence = Cadence()) -> DataFrame:
    return core_only(drop_bursts(spread(df, 0.0, cadence.burst_max), cadence)).drop(US, CHUNK)


def fill_gaps(df: DataFrame, cadence: Cadence = Cadence()) -> DataFrame:
    return core_only(repaired_chunks(df, cadence=cadence)).drop(US, CHUNK, SEG, "_start")


def number_segments(df: DataFrame, out: str = "segment_id") -> DataFrame:
    """Station-wide 0-based segment ids from ``_start`` flags on core rows (needs ``_chunk``)."""
    df = running_total(df, [KEY], [US], F.col("_start"), out)
    return df.withColumn(out, F.col(out) - 1)


def segments(df: DataFrame, rule: GapRule, bursts: Cadence | None = None) -> DataFrame:
    """Segment ids under any gap rule, without gap filling."""
    lead = bursts.burst_max if bursts else 0.0
    df = spread(df, rule.high, lead)
    if bursts:
        df = drop_bursts(df, bursts)
    return number_segments(core_only(mark_segments(df, rule))).drop(US, CHUNK, SEG, "_start")


def repaired_series(df: DataFrame, cadence: Cadence = Cadence()) -> DataFrame:
    """Burst-free, gap-filled readings with station-wide ``segment_id``."""
    return number_segments(core_only(repaired_chunks(df, cadence=cadence))).drop(US, CHUNK, SEG, "_start")


def extend_tail(df: DataFrame, now: Column, rule: LiveRule = LiveRule()) -> DataFrame:
    """Repeat the newest row of a briefly silent station every step up to ``now`` minus slack.

    Returns the history plus the synthetic rows; only per-station maxima shuffle.
    """
    for marker in (FILLED, TAIL):
        if marker not in df.columns:
            df = df.withColumn(marker, F.lit(0.0))
    cols = [c for c in df.columns if c != KEY]
    newest = df.groupBy(KEY).agg(F.max(F.struct(F.col("ts"), *[F.col(c) for c in cols if c != "ts"])).alias("r"))
    now_us = F.unix_micros(now)
    last = F.unix_micros(F.col("r.ts"))
    age = (now_us - last) / 1e6
    steps = F.floor((now_us - micros(rule.slack) - last) / float(micros(rule.step))).cast("int")
    tail = (
        newest.filter((age > rule.fresh) & (age <= rule.bridged))
        .withColumn("k", F.explode(F.sequence(F.lit(1), steps)))
        .select(
            KEY,
            *[
                F.timestamp_micros(last + F.col("k") * micros(rule.step)).alias("ts") if c == "ts"
                else F.lit(1.0).alias(c) if c in (FILLED, TAIL)
                else F.col(f"r.{c}").alias(c)
                for c in cols
            ],
        )
    )
    return df.unionByName(tail)


def live_gate(df: DataFrame, now: Column, required: Sequence[str], rule: LiveRule = LiveRule()) -> DataFrame:
    """Newest row per station and why it may not be used for a live forecast."""
    newest = df.groupBy(KEY).agg(
        F.max("ts").alias("newest_ts"),
        F.max_by(F.struct(*required), "ts").alias("r"),
    )
    age = (F.unix_micros(now) - F.unix_micros("newest_ts")) / 1e6
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(f"r.{c}").isNull()
    status = (
        F.when((age > rule.bridged) | (age < -rule.future), "not_current")
        .when(missing, "insufficient_context")
        .otherwise("ready")
    )
    return newest.select(KEY, "newest_ts", age.alias("age_seconds"), status.alias("status"))
