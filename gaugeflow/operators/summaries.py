"""Period summaries, day/night forecast digests, pressure baseline, wet windows, slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import comfort_class, heat_index, pressure_anomaly
from ..functions.units import weather_words
from ..policy import HOUR, LOCAL_OFFSET_HOURS
from .chunks import KEY


def local(ts: str | Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    """UTC timestamp shifted to the local wall clock."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.unix_micros(col) + offset_hours * HOUR)


def period_summary(readings: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Extremes, means, rain minutes (any rain at all) and heat index per period."""
    df = readings.withColumn("_heat", heat_index(F.col("temp"), F.col("humidity")))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), F.avg("temp").alias("temp_avg"),
        F.min("humidity").alias("humidity_min"), F.max("humidity").alias("humidity_max"), F.avg("humidity").alias("humidity_avg"),
        F.min("pressure").alias("pressure_min"), F.max("pressure").alias("pressure_max"),
        F.count(F.when(F.col("rain_flag") > 0, 1)).cast("double").alias("rain_minutes"),
        F.max("_heat").alias("heat_index_max"), F.avg("_heat").alias("heat_index_avg"),
    )
    return out.withColumn("comfort_level_peak", comfort_class(F.col("heat_index_max")))


_MEASURES = ("temp", "humidity", "pressure", "_heat")


def summary_state(readings: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """What a part of a period contributes to its summary: extremes, sums and counts that can be merged."""
    df = readings.withColumn("_heat", heat_index(F.col("temp"), F.col("humidity")))
    parts = [f(c).alias(f"{n}_{c}") for c in _MEASURES for n, f in (("min", F.min), ("max", F.max), ("sum", F.sum), ("known", F.count))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("rain_flag") > 0, 1)).alias("rainy"), *parts)


def summary_of_states(states: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """The summary that ``period_summary`` makes of the rows behind the states."""
    def mean(c: str) -> Column:
        return F.sum(f"sum_{c}") / F.sum(f"known_{c}")

    out = states.groupBy(*by).agg(
        F.sum("rows").alias("count"),
        *[x for c in _MEASURES[:2] for x in (F.min(f"min_{c}").alias(f"{c}_min"), F.max(f"max_{c}").alias(f"{c}_max"), mean(c).alias(f"{c}_avg"))],
        F.min("min_pressure").alias("pressure_min"), F.max("max_pressure").alias("pressure_max"), F.sum("rainy").cast("double").alias("rain_minutes"),
        F.max("max__heat").alias("heat_index_max"), mean("_heat").alias("heat_index_avg"))
    return out.withColumn("comfort_level_peak", comfort_class(F.col("heat_index_max")))


def daily_summary(readings: DataFrame) -> DataFrame:
    return period_summary(readings, [KEY, F.to_date(local("ts")).alias("date")])


def trailing(end: Column, days: int, ts: str = "ts") -> Column:
    """The last ``days`` days before ``end``; with a literal end the bounds reach the scan."""
    start = F.timestamp_micros(F.unix_micros(end) - days * 24 * HOUR)
    return (F.col(ts) >= start) & (F.col(ts) < end)


def trailing_summary(readings: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """Summary of the last ``days`` days before ``end``."""
    return period_summary(readings.filter(trailing(end, days)), [KEY])


def day_night(hourly: DataFrame, by: Sequence[str], time: str = "valid_at") -> DataFrame:
    """Digest of today 06-18 and tonight 18-06 local time of each issue.

    The day is that of the first hour of the issue; the condition is that of
    the first hour with the highest rain probability.
    """
    by = list(by)
    at = F.unix_micros(F.col(time)) + LOCAL_OFFSET_HOURS * HOUR
    df = hourly.withColumn("_at", at)
    first = df.groupBy(*by).agg((F.floor(F.min("_at") / float(24 * HOUR)) * 24 * HOUR).cast("long").alias("_day"))
    df = df.join(first, by).withColumn("_h", (F.col("_at") - F.col("_day")) / float(HOUR))
    period = F.when((F.col("_h") >= 6) & (F.col("_h") < 18), "today").when((F.col("_h") >= 18) & (F.col("_h") < 30), "tonight")
    df = df.withColumn("period", period).filter(F.col("period").isNotNull())
    # Nulls never win: the pair is null where the probability is.
    peak = F.when(F.col("rain_prob").isNotNull(), F.struct(F.col("rain_prob"), -F.col("_at")))
    return df.groupBy(*by, "period").agg(
        F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), F.max("rain_prob").alias("rain_prob_max"),
        weather_words(F.max_by("weathercode", peak)).alias("condition"))


def pressure_baseline(readings: DataFrame, now: Column, hour: int = 6, days: int = 7, min_days: int = 3, band: float = 0.5) -> DataFrame:
    """Mean of the daily means at one local hour over the last ``days`` days, and today's anomaly."""
    df = readings.filter(trailing(now, 8))
    newest = df.groupBy(KEY).agg(F.max_by("pressure", "ts").alias("current"))
    wall = local("ts")
    mornings = df.filter((F.hour(wall) == hour) & (F.to_date(wall) != F.to_date(local(now))))
    daily = mornings.groupBy(KEY, F.to_date(wall).alias("_d")).agg(F.avg("pressure").alias("_m"))
    recent = daily.withColumn("_k", F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("_d").desc())))
    base = recent.filter(F.col("_k") <= days).groupBy(KEY).agg(F.count(F.lit(1)).alias("days"), F.avg("_m").alias("baseline"))
    base = base.filter(F.col("days") >= min_days).join(newest, KEY)
    anomaly = F.col("current") - F.col("baseline")
    return base.select(KEY, "days", "baseline", anomaly.alias("anomaly"), pressure_anomaly(anomaly, band).alias("direction"))


def wet_windows(hourly: DataFrame, by: Sequence[str], order: str = "valid_at", threshold: float = 50.0) -> DataFrame:
    """Runs of consecutive forecast hours at or above the threshold (an issue holds a few dozen hours)."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    wet = F.coalesce(F.col("rain_prob") >= threshold, F.lit(False))
    df = hourly.withColumn("_wet", wet).withColumn("_island", F.sum((~F.col("_wet")).cast("int")).over(w))
    return df.filter("_wet").groupBy(*by, "_island").agg(
        F.min(order).alias("window_start"), F.max(order).alias("window_end"), F.count(F.lit(1)).alias("hours")
    ).drop("_island")


def first_wet_hour(hourly: DataFrame, by: Sequence[str], order: str = "valid_at", threshold: float = 50.0) -> DataFrame:
    return hourly.groupBy(*by).agg(F.min(F.when(F.col("rain_prob") >= threshold, F.col(order))).alias("first_wet"))


def first_rows(df: DataFrame, by: Sequence[str], order: str, k: int) -> DataFrame:
    """First ``k`` rows of each group (Spark keeps only k per partition before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def missed_slots(days: DataFrame, sent: DataFrame, now: Column, slots: Sequence[int] = (6, 21)) -> DataFrame:
    """Daily slots already due by local ``now`` without a delivery record."""
    due = days.withColumn("slot_hour", F.explode(F.array(*[F.lit(s) for s in slots])))
    wall = local(now)
    due = due.filter(
        (F.col("date") < F.to_date(wall)) | ((F.col("date") == F.to_date(wall)) & (F.hour(wall) >= F.col("slot_hour"))))
    return due.join(sent, [KEY, "date", "slot_hour"], "left_anti")


def confidence(frame: DataFrame, now: Column | None, context: int = 120, fresh: float = 180.0) -> DataFrame:
    """Data confidence of the newest segment: coverage x age x repaired share.

    ``frame`` carries ``segment_id`` and the repair markers.  Only the newest
    segment's newest ``context`` rows matter; they are picked by a per-group
    top-k, which Spark applies before the shuffle.
    """
    newest = frame.groupBy(KEY).agg(F.max("segment_id").alias("segment_id"), F.max("ts").alias("newest_ts"))
    rank = F.row_number().over(Window.partitionBy(KEY, "segment_id").orderBy(F.col("ts").desc()))
    tail = frame.withColumn("_k", rank).filter(F.col("_k") <= context).join(newest, [KEY, "segment_id"])
    tail_mark = F.col("simulation_tail_filled") if "simulation_tail_filled" in frame.columns else F.lit(0.0)
    df = tail.groupBy(KEY, "newest_ts").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.coalesce("observation_gap_filled", F.lit(0.0))).cast("int").alias("repaired"),
        F.sum(F.coalesce(tail_mark, F.lit(0.0))).cast("int").alias("simulated"))
    coverage = F.least(F.lit(1.0), F.col("_rows") / float(context))
    if now is None:
        age, age_factor = F.lit(None).cast("double"), F.lit(1.0)
    else:
        age = (F.unix_micros(now) - F.unix_micros("newest_ts")) / 1e6
        age_factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.greatest(age, F.lit(0.0)) / fresh))
    gap_factor = F.greatest(F.lit(0.75), 1.0 - F.col("repaired") / 120.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage * age_factor * gap_factor))
    level = F.when(score >= 0.85, "high").when(score >= 0.55, "medium").otherwise("low")
    reason = (
        F.when(F.col("simulated") > 0, "latest sensor outage temporarily simulated")
        .when(F.col("repaired") > 0, "short sensor gap repaired")
        .when(coverage < 1.0, "short or interrupted sensor context")
        .when((F.lit(now is not None)) & (age_factor < 1.0), "latest sensor observation is aging")
        .otherwise("continuous sensor context")
    )
    return df.select(
        KEY, age.alias("data_age_seconds"), coverage.alias("feature_coverage"), "repaired", "simulated",
        score.alias("data_confidence"), level.alias("confidence_level"), reason.alias("confidence_reason"))
