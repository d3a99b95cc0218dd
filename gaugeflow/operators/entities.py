"""Assemble one reading per poll from the latest reported state of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions import units as U
from .chunks import CHUNK, KEY, carry, micros, with_chunk

REQUIRED = ("temp", "humidity", "pressure")
OPTIONAL = ("light", "wind_speed", "wind_gust", "wind_direction")


@dataclass(frozen=True)
class Freshness:
    default: float = 180.0
    humidity: float = 600.0
    binary_rain: bool = False  # the rain entity is a contact, whatever its state text


def latest_states(states: DataFrame, poll: str = "poll_at") -> DataFrame:
    """One row per (station, poll) with a struct per entity; the newest report of an entity wins.

    A map-side combinable aggregate: nothing is collected or sorted.
    """
    observed = U.observed_at(*[F.col(c) for c in ("last_reported", "last_updated", "last_changed") if c in states.columns])
    row = F.struct(F.col("state"), F.col("unit"), observed.alias("at"))
    return states.groupBy(KEY, poll).agg(*[
        F.max_by(F.when(F.col("entity") == e, row), F.when(F.col("entity") == e, observed)).alias(e)
        for e in (*REQUIRED, "rain", *OPTIONAL)
    ])


def assemble(states: DataFrame, now: Column, fresh: Freshness = Freshness(), poll: str = "poll_at") -> DataFrame:
    """Normalised readings with ``status`` and the first ``reason`` that refused a poll.

    Temperature, humidity and pressure must exist, be fresh and be valid; rain
    must be readable if reported; stale optional states become null.
    """
    df = latest_states(states, poll)
    at = {e: F.col(f"{e}.at") for e in (*REQUIRED, "rain", *OPTIONAL)}
    age = {e: U.age_seconds(now, at[e]) for e in at}
    limit = {e: fresh.humidity if e == "humidity" else fresh.default for e in at}
    state = {e: F.col(f"{e}.state") for e in at}
    stale = {e: age[e] > limit[e] for e in at}

    def unless_stale(e: str, value: Column) -> Column:
        return F.when(~F.coalesce(stale[e], F.lit(False)), value)

    def unit(e: str) -> Column:
        return F.col(f"{e}.unit")

    contact = F.lit(True) if fresh.binary_rain else U.is_contact_word(state["rain"])
    # Three projections, so that no conversion is repeated inside the later ones.
    df = df.withColumns({
        "_temp": U.celsius(state["temp"], unit("temp")),
        "_humidity": U.humidity_percent(state["humidity"], unit("humidity")),
        "_pressure": U.hectopascal(state["pressure"], unit("pressure")),
        "_wind_speed": unless_stale("wind_speed", U.metres_per_second(state["wind_speed"], unit("wind_speed"))),
        "_wind_gust": unless_stale("wind_gust", U.metres_per_second(state["wind_gust"], unit("wind_gust"))),
        "_wind_direction": unless_stale("wind_direction", U.wind_degrees(state["wind_direction"])),
        "_light": unless_stale("light", U.light_text(state["light"])),
        "_amount": U.rain_amount(state["rain"]),
        "_timed_rain": F.col("rain").isNotNull() & ~contact,
        "_rain_at": F.when(F.col("rain").isNotNull() & (~contact | ~F.coalesce(stale["rain"], F.lit(True))), at["rain"]),
    })
    reason = F.lit(None).cast("string")
    checks = []
    for e in REQUIRED:
        checks += [(at[e].isNull(), f"missing_timestamp_{e}"), (stale[e], f"stale_{e}")]
    checks += [
        (F.col("_timed_rain") & at["rain"].isNull(), "missing_timestamp_rain"),
        (F.col("_timed_rain") & stale["rain"], "stale_rain"),
    ]
    checks += [(F.col(f"_{e}").isNull(), f"invalid_{e}") for e in REQUIRED]
    checks += [(F.col("rain").isNotNull() & F.col("_amount").isNull(), "invalid_rain")]
    for test, name in reversed(checks):
        reason = F.when(test, name).otherwise(reason)
    df = df.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNull(), "ready").when(F.col("reason").startswith("stale"), "stale").otherwise("unavailable"))
    wet = F.col("_amount") > 0.1
    wind = F.coalesce("_wind_speed", "_wind_gust", "_wind_direction").isNotNull()
    ok = F.col("reason").isNull()
    out = {
        "ts": F.least(*[at[e] for e in REQUIRED], F.col("_rain_at")),
        **{e: rounded(F.col(f"_{e}"), 4) for e in REQUIRED},
        "rain": wet, "rain_flag": F.when(F.coalesce(wet, F.lit(False)), 1.0).otherwise(0.0), "rain_sensor": F.col("_amount"),
        "light": F.col("_light"), "wind_available": wind.cast("double"),
        **{e: rounded(F.col(f"_{e}"), 4) for e in ("wind_speed", "wind_gust", "wind_direction")},
    }
    return df.select(KEY, poll, status.alias("status"), "reason", *[F.when(ok, c).alias(n) for n, c in out.items()])


def fingerprint(*cols: str, doubles: Sequence[str] = ()) -> Column:
    """Stable hash of a row: canonical JSON, ``doubles`` with six decimals, first 20 hex digits."""
    fields = [F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))).alias(c) if c in doubles else F.col(c) for c in cols]
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, 20)


def drop_repeats(df: DataFrame, order: str, hashed: Column, by=(KEY,)) -> DataFrame:
    """Drop rows equal to the row just before them in their series."""
    by = list(by)
    df = with_chunk(df, ts=order).withColumn("_h", hashed)
    df = carry(df, by, [F.max_by("_h", order).alias("_end")], {"_before": lambda w: F.lag("_end").over(w)})
    prev = F.coalesce(F.lag("_h").over(Window.partitionBy(*by, CHUNK).orderBy(order)), F.col("_before"))
    df = df.withColumn("_prev", prev)
    return df.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("_h"))).drop("_prev", "_before", "_h", CHUNK)
