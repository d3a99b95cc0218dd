"""Live reading ingest: key-unique readings, freshness, outcomes of forecasts, window summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import comfort_class, heat_index
from ..operators.chunks import KEY, bucket, micros
from ..policy import MINUTE, RAIN_THRESHOLD, LiveRule, MatchRule
from .storage import store_unique  # noqa: F401  (part of ingest)


def unique_readings(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """First arrival of each (station, time); state is dropped once the watermark passes.

    A row later than ``delay`` is dropped by the engine: where such rows must be
    kept, use ``storage.store_unique``.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([KEY, ts])


def fresh_rows(stream: DataFrame, now: Column, observed: Column, limit: Column | float, rule: LiveRule = LiveRule()) -> DataFrame:
    """Rows whose observation is at most ``limit`` seconds old and not in the future."""
    age = (F.unix_micros(now) - F.unix_micros(observed)) / 1e6
    return stream.filter((age <= limit) & (age >= -rule.future))


def outcomes(
    forecasts: DataFrame, readings: DataFrame, delay: str = "3 hours", rule: MatchRule = MatchRule(), width: int = 10 * MINUTE
) -> DataFrame:
    """Forecasts joined to the readings around their valid time, as both streams arrive.

    The join key holds a time bucket (a forecast is copied to the one or two
    buckets its tolerance touches), so a row probes a few neighbours instead
    of all buffered rows of its station; the time-range condition bounds the
    state on both sides.
    """
    tol = micros(rule.point_tolerance)
    at = F.unix_micros("valid_at")
    f = forecasts.withWatermark("valid_at", delay).select(
        KEY, "issued_at", "valid_at", "lead_minutes", "rain_prob", "source_layer",
        F.explode(F.sequence(bucket(at - tol, width), bucket(at + tol, width))).alias("_bucket"))
    r = readings.withWatermark("ts", delay).select(
        F.col(KEY).alias("_station"), "ts", "rain_flag", bucket(F.unix_micros("ts"), width).alias("_slot"))
    slack = f"interval {int(rule.point_tolerance)} seconds"
    near = F.expr(f"{KEY} = _station and _bucket = _slot and ts >= valid_at - {slack} and ts <= valid_at + {slack}")
    return f.join(r, near).drop("_station", "_bucket", "_slot")


def settled_outcomes(forecasts: DataFrame, readings: DataFrame, delay: float = 300.0, rule: MatchRule = MatchRule(), width: int = 10 * MINUTE) -> DataFrame:
    """Every forecast once it has matured, with the reading that settles it, or with none.

    A forecast comes out when both streams have passed the end of its time slot
    by ``rule.max_lead`` minutes, the tolerance and ``delay`` seconds: all
    forecasts issued with it are due then, and no reading of it can still come.
    It gets the reading that ``match_point`` picks (``matched_at, rain_flag,
    actual``); these are null if no reading is within reach.

    An outer join on slots: forecasts of a (station, slot) and the readings
    within reach of the slot are one state row, so a busy station is dealt to
    many tasks and a row of state holds ten minutes of one station. A reading
    near an edge is copied to the neighbouring slot. Equal forecasts each come
    out; rows without a time are no rows.
    """
    tol = micros(rule.point_tolerance)
    wait = f"{int(delay + rule.max_lead * 60 + rule.point_tolerance)} seconds"
    given = ("issued_at", "valid_at", "lead_minutes", "rain_prob", "source_layer")
    forecast, reading = F.struct(*given), F.struct(F.unix_micros("ts").alias("us"), F.col("rain_flag").alias("rain"))
    f = forecasts.select(KEY, F.col("valid_at").alias("_at"), forecast.alias("_f"))
    us, slot = F.unix_micros("ts"), F.col("_slot")
    r = readings.select(KEY, "ts", "rain_flag", F.explode(F.sequence(bucket(us - tol, width), bucket(us + tol, width))).alias("_slot"))
    r = r.select(KEY, F.timestamp_micros(F.greatest(slot * width, F.least(us, (slot + 1) * width - 1))).alias("_at"), reading.alias("_r"))
    both = f.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withWatermark("_at", wait).unionByName(
        r.withColumn("_f", F.lit(None).cast(f.schema["_f"].dataType)).withWatermark("_at", wait))
    held = both.groupBy(KEY, F.window("_at", f"{width} microseconds")).agg(F.collect_list("_f").alias("_fs"), F.collect_list("_r").alias("_rs"))
    due = held.select(KEY, "_rs", F.explode("_fs").alias("f"))
    at = F.unix_micros("f.valid_at")

    def distance(x: Column) -> Column:
        step = bucket(x["us"], MINUTE) - bucket(at, MINUTE)
        rank = F.when(step == 0, 0).when(step == -1, 1).when(step == 1, 2)
        return F.when(rank.isNotNull() & (F.abs(x["us"] - at) <= tol), F.struct(F.abs(x["us"] - at).alias("d"), rank.alias("rank"), x["us"].alias("us"), x["rain"].alias("rain")))

    best = due.withColumn("_m", F.array_min(F.filter(F.transform("_rs", distance), lambda m: m.isNotNull())))
    return best.select(
        KEY, *[f"f.{c}" for c in given], F.timestamp_micros("_m.us").alias("matched_at"), F.col("_m.rain").alias("rain_flag"), (F.col("_m.rain") > RAIN_THRESHOLD).cast("int").alias("actual"))


def summaries(stream: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour", offset: str | None = None) -> DataFrame:
    """Period summary per station in tumbling or sliding event-time windows.

    ``offset`` moves the day boundary, e.g. 17 hours for local midnight at UTC+7.
    """
    heat = heat_index(F.col("temp"), F.col("humidity"))
    w = F.window("ts", length, slide or length, offset) if offset else F.window("ts", length, slide or length)
    out = stream.withWatermark("ts", delay).withColumn("_heat", heat).groupBy(KEY, w.alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), F.avg("temp").alias("temp_avg"),
        F.min("pressure").alias("pressure_min"), F.max("pressure").alias("pressure_max"),
        F.sum(F.when(F.col("rain_flag") > 0, 1.0).otherwise(0.0)).alias("rain_minutes"), F.max("_heat").alias("heat_index_max"))
    return out.select(KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (KEY, "w")],
                      comfort_class(F.col("heat_index_max")).alias("comfort_level_peak"))


def rain_windows(stream: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Gap-based rain sessions; the sample-count closure is in :mod:`stateful`."""
    wet = stream.filter(F.col("rain_flag") > 0.1).withWatermark("ts", delay)
    return wet.groupBy(KEY, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("wet_samples")).select(
        KEY, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "wet_samples")
