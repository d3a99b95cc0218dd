"""Forecast documents and objects flattened to log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import weather_words
from ..policy import HOUR, LOCAL_OFFSET_HOURS, MINUTE
from ..operators.chunks import KEY

HOURLY = "time array<string>, temperature_2m array<double>, precipitation_probability array<double>, precipitation array<double>, wind_speed_10m array<double>, wind_direction_10m array<double>, cloud_cover array<double>, weathercode array<int>"
DAILY = "time array<string>, temperature_2m_min array<double>, temperature_2m_max array<double>, precipitation_probability_max array<double>, precipitation_sum array<double>, wind_speed_10m_max array<double>, uv_index_max array<double>, sunrise array<string>, sunset array<string>, weather_code array<int>"
DOCUMENT = f"current struct<time:string>, hourly struct<{HOURLY.replace(' array', ':array')}>, daily struct<{DAILY.replace(' array', ':array')}>"
# Output name -> source array of the hourly and the daily block.
HOURLY_FIELDS = {
    "temp": "temperature_2m", "rain_prob": "precipitation_probability", "precip_mm": "precipitation",
    "wind_kmh": "wind_speed_10m", "wind_dir_deg": "wind_direction_10m", "cloud_cover": "cloud_cover", "weathercode": "weathercode",
}
DAILY_FIELDS = {
    "temp_min": "temperature_2m_min", "temp_max": "temperature_2m_max", "rain_prob_max": "precipitation_probability_max",
    "precip_mm": "precipitation_sum", "wind_kmh_max": "wind_speed_10m_max", "uv_index_max": "uv_index_max",
    "sunrise": "sunrise", "sunset": "sunset", "weathercode": "weather_code",
}


def parse_documents(df: DataFrame, text: str = "document") -> DataFrame:
    return df.withColumn("_doc", F.from_json(F.col(text), DOCUMENT))


def _rows(df: DataFrame, block: str, fields: dict[str, str], keep) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema["_doc"].dataType[block].dataType.fields}
    # An absent array counts as empty, so its column is null instead of losing the rows.
    arrays = [F.col(f"_doc.{block}.time").alias("time"), *[
        F.coalesce(F.col(f"_doc.{block}.{src}"), F.array().cast(kinds[src])).alias(n)
        for n, src in fields.items()]]
    return df.select(*keep, "_doc", F.posexplode(F.arrays_zip(*arrays)).alias("_i", "_e")).select(*keep, "_doc", "_i", "_e.*")


def hourly_timeline(df: DataFrame, keep, hours: int = 24) -> DataFrame:
    """Up to ``hours`` rows from the current hour on; ``lead_hours`` counts from that hour.

    If the document does not list the current hour the first hour is used.
    """
    rows = _rows(parse_documents(df), "hourly", HOURLY_FIELDS, keep)
    times = F.col("_doc.hourly.time")
    now = F.concat(F.substring(F.coalesce(F.col("_doc.current.time"), F.element_at(times, 1)), 1, 13), F.lit(":00"))
    start = F.array_position(times, now).cast("int") - 1
    first = F.when(start >= 0, start).otherwise(0)
    rows = rows.withColumns({"lead_hours": F.col("_i") - first, "issued_hour": now})
    rows = rows.filter((F.col("lead_hours") >= 0) & (F.col("lead_hours") < hours))
    return rows.withColumn("condition", weather_words(F.col("weathercode"))).drop("_doc", "_i")


def daily_forecast(df: DataFrame, keep, days: int = 7) -> DataFrame:
    """Rows of the first ``days`` days."""
    rows = _rows(parse_documents(df), "daily", DAILY_FIELDS, keep)
    rows = rows.filter(F.col("_i") < days).withColumn("condition", weather_words(F.col("weathercode")))
    return rows.withColumnRenamed("_i", "day_index").withColumnRenamed("time", "date").drop("_doc")


def utc_of_local(text: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return F.timestamp_micros(F.unix_micros(text.try_cast("timestamp")) - offset_hours * HOUR)


def nwp_log_rows(timeline: DataFrame) -> DataFrame:
    """Log rows of a timeline: UTC times, lead from the issue hour, wind in m/s; null temperatures dropped."""
    issued, valid = utc_of_local(F.col("issued_hour")), utc_of_local(F.col("time"))
    lead = F.bround((F.unix_micros(valid) - F.unix_micros(issued)) / float(HOUR), 0).cast("int")
    df = timeline.withColumns({"_issued": issued, "_valid": valid, "_lead": lead}).filter(F.col("temp").isNotNull() & (F.col("_lead") >= 0))
    return df.select(
        KEY, F.col("_issued").alias("issued_hour"), F.col("_valid").alias("valid_at"), F.col("_lead").alias("lead_hours"),
        F.col("temp").alias("temp_forecast"), F.col("rain_prob").alias("precipitation_probability"),
        F.col("precip_mm").alias("precipitation"), "weathercode", (F.col("wind_kmh") / 3.6).alias("wind_speed"),
        F.col("wind_dir_deg").alias("wind_direction"), "cloud_cover")


def forecast_log_rows(predictions: DataFrame) -> DataFrame:
    """Log rows of issued predictions: one per horizon, plus the radar arrival if one is claimed.

    Input: station, ``issued_at``, ``model``, ``probabilities`` map of horizon
    labels to probabilities, ``arrival`` struct(rain_arriving, eta_minutes,
    confidence) or null.
    """
    local = predictions.select(KEY, "issued_at", "model", F.explode("probabilities").alias("_h", "rain_prob")).select(
        KEY, "issued_at", F.regexp_extract("_h", r"^(\d+)m$", 1).cast("int").alias("lead_minutes"), "rain_prob",
        F.concat(F.lit("local_"), F.col("model")).alias("source_layer"))
    radar = predictions.filter("arrival.rain_arriving").select(
        KEY, "issued_at", F.col("arrival.eta_minutes").cast("int").alias("lead_minutes"), F.col("arrival.confidence").alias("rain_prob"),
        F.lit("radar_advection").alias("source_layer"))
    valid = F.timestamp_micros(F.unix_micros("issued_at") + F.col("lead_minutes").cast("long") * MINUTE)
    return local.unionByName(radar).withColumn("valid_at", valid)
