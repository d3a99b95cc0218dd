"""One forecast table from nowcast, arrival, hourly and daily layers, and source status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import KEY


def layers(nowcast: DataFrame, arrival: DataFrame, hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Long union ``(station, layer, source, lead_minutes, value columns)``.

    nowcast: station, lead_minutes, rain_prob, source.  arrival: station,
    eta_minutes, expected_intensity, confidence, rain_arriving.  hourly:
    station, lead_hours, temp, rain_prob.  daily: station, day_index,
    temp_min, temp_max, rain_prob_max.
    """
    now = nowcast.select(KEY, F.lit("nowcast").alias("layer"), "source", F.col("lead_minutes").cast("int").alias("lead_minutes"), "rain_prob")
    arr = arrival.filter("rain_arriving").select(
        KEY, F.lit("arrival").alias("layer"), F.lit("radar_advection").alias("source"),
        F.col("eta_minutes").cast("int").alias("lead_minutes"), F.col("expected_intensity").cast("int").alias("intensity"), "confidence")
    hour = hourly.select(
        KEY, F.lit("hourly").alias("layer"), F.lit("nwp").alias("source"), (F.col("lead_hours") * 60).cast("int").alias("lead_minutes"),
        "temp", "rain_prob")
    day = daily.select(
        KEY, F.lit("daily").alias("layer"), F.lit("nwp").alias("source"), (F.col("day_index") * 1440).cast("int").alias("lead_minutes"),
        "temp_min", "temp_max", F.col("rain_prob_max").alias("rain_prob"))
    out = now
    for part in (arr, hour, day):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def source_status(blended: DataFrame, stations: DataFrame) -> DataFrame:
    """ready with local forecasts, partial with any other source, else unavailable."""
    def has(*names: str) -> Column:
        return F.coalesce(F.max(F.col("layer").isin(*names)), F.lit(False))

    flags = blended.groupBy(KEY).agg(
        has("nowcast").alias("local"), has("hourly", "daily").alias("nwp"), has("arrival").alias("radar"))
    out = stations.select(KEY).join(flags, KEY, "left")
    word = {c: F.when(F.coalesce(c, F.lit(False)), "ready").otherwise("unavailable") for c in ("local", "nwp", "radar")}
    any_source = F.coalesce(F.col("local") | F.col("nwp") | F.col("radar"), F.lit(False))
    status = F.when(F.coalesce("local", F.lit(False)), "ready").when(any_source, "partial").otherwise("unavailable")
    return out.select(KEY, *[c.alias(n) for n, c in word.items()], status.alias("status"))


def forecast_object(
    blended: DataFrame, now: DataFrame | None = None, confidence: DataFrame | None = None, rain_stop: DataFrame | None = None
) -> DataFrame:
    """One row per station with an ordered array per layer (a few dozen entries each) and where each layer came from.

    ``now``, ``confidence`` (``level, data_confidence, reason``) and
    ``rain_stop`` are one row per station and become structs; a station without
    a confidence has none in its local model.
    """
    def packed(layer: str, *fields: str) -> Column:
        row = F.when(F.col("layer") == layer, F.struct("lead_minutes", "source", *fields))
        return F.sort_array(F.collect_list(row)).alias(layer)

    def source(layer: str) -> Column:
        return F.max(F.when(F.col("layer") == layer, F.col("source"))).alias(layer)

    local = F.sort_array(F.collect_set(F.when(F.col("layer") == "nowcast", F.col("source")))).alias("nowcast")
    out = blended.groupBy(KEY).agg(
        packed("nowcast", "rain_prob"), packed("arrival", "intensity", "confidence"),
        packed("hourly", "temp", "rain_prob"), packed("daily", "temp_min", "temp_max", "rain_prob"),
        F.struct(local, source("hourly"), source("daily"), source("arrival")).alias("sources"))
    for name, part in (("now", now), ("confidence", confidence), ("rain_stop", rain_stop)):
        if part is not None:
            rest = [c for c in part.columns if c != KEY]
            out = out.join(part.select(KEY, F.struct(*rest).alias(name)), KEY, "left")
    # What is said of a station without a local model.
    none = F.struct(F.lit("low").alias("level"), F.lit(0.0).alias("data_confidence"), F.lit("no local sensor model").alias("reason"))
    return out.withColumn("confidence", F.coalesce(F.col("confidence"), none) if confidence is not None else none)
