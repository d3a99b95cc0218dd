"""Feature frame: 202 lag, rolling, rate, rain, light, calendar and context columns.

Everything after the single (station, chunk) shuffle of the repair is window
expressions over one (station, chunk, segment) ordering plus projections, so a
caller that selects a family of columns pays only for that family.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.physics import (
    clear_sky_light, clip, cyclic, dew_point, modulo, solar_elevation,
)
from ..functions.units import compass_degrees, truth_value
from ..policy import Cadence
from .chunks import CHUNK, US, core_only
from .labels import segment_window
from .segments import SEG, repaired_chunks

CORE3 = ("pressure", "humidity", "temp")
LONG2 = ("pressure", "humidity")
LAGS, LONG_LAGS = (5, 10, 15, 30, 60), (90, 120)
ROLLS = (5, 15, 30, 60)
CONTEXT_ROWS = 120

# Optional inputs and the value that stands for "not reported".
OPTIONAL_DEFAULTS = {
    "radar_available": 0.0, "radar_point_intensity": 0.0, "radar_nearby_max_intensity": 0.0,
    "radar_trend_rising": 0.0, "cloud_available": 0.0, "cloud_cover_now": 0.0,
    "cloud_cover_low_now": 0.0, "cloud_trend_rising": 0.0, "wind_available": 0.0,
    "wind_speed": 0.0, "wind_gust": 0.0, "wind_direction": 0.0, "nwp_available": 0.0,
    "nwp_precipitation_probability": 0.0, "nwp_precipitation": 0.0, "nwp_weathercode": 0.0,
    "nwp_wind_speed": 0.0, "nwp_wind_direction": 0.0, "nwp_cloud_cover": 0.0,
    "nwp_lead_hours": 0.0, "nwp_age_seconds": 999999.0,
}
RAIN_DERIVED = ("rain_flag", "rain_sensor", "rain_now")


Recipe = dict[str, Callable[[], Column]]  # columns are only built when asked for


def _lag(c: Column | str, n: int) -> Column:
    return F.lag(c, n).over(segment_window())


def _change(c: str, n: int) -> Column:
    return F.col(c) - _lag(c, n)


def _slope(c: str, n: int) -> Column:
    """Change per elapsed minute (measured time, not row count)."""
    elapsed = (F.col(US) - _lag(US, n)) / 60e6
    return _change(c, n) / F.when(elapsed > 0, elapsed)


def _bright(value: Column) -> Column:
    return F.when(F.col("daylight_available") > 0.0, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def lag_spec() -> dict[str, tuple[str, int]]:
    """Lag feature -> (column, rows): the value then, and twice its change since."""
    pairs = [(c, n) for c in CORE3 for n in (*LAGS, *(LONG_LAGS if c in LONG2 else ()))]
    return {name: (c, n) for c, n in pairs for name in (f"{c}_{n}m_ago", f"{c}_delta_{n}m", f"{c}_trend_{n}m")}


def add_lags(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Lag features among ``wanted``; every lag is looked up once and the changes are taken from it."""
    spec = {name: at for name, at in lag_spec().items() if name in wanted}
    then = {f"_{c}_{n}_ago": _lag(c, n) for c, n in spec.values()}
    named = {
        name: F.col(f"_{c}_{n}_ago") if name.endswith("_ago") else F.col(c) - F.col(f"_{c}_{n}_ago") for name, (c, n) in spec.items()}
    return df.withColumns(then).withColumns(named).drop(*then) if spec else df


# A window of n rows is put together from shorter ones, newest first: the five-row
# frames are the only ones Spark slides over, all others are lags of results.
LADDER = ({10: (5, 5), 15: (5, 5, 5)}, {30: (15, 15)}, {60: (30, 30)}, {90: (60, 30), 120: (60, 60)})
BASE = 5


def _part(stat: str, c: str, n: int) -> str:
    return f"_{stat}_{c}_{n}"


def _base_stat(stat: str, c: str) -> Column:
    frame = segment_window().rowsBetween(-(BASE - 1), 0)
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "m2": F.var_pop}[stat]
    value = fn(c).over(frame) * float(BASE) if stat == "m2" else fn(c).over(frame)
    return F.when(F.count(c).over(frame) == BASE, value)


def _joined(stat: str, c: str, n: int, pieces: tuple) -> Column:
    """Statistic of ``n`` rows from those of its pieces; null unless all exist."""
    offsets = [sum(pieces[:i]) for i in range(len(pieces))]

    def piece(s: str, i: int) -> Column:
        col = F.col(_part(s, c, pieces[i]))
        return _lag(col, offsets[i]) if offsets[i] else col

    values = [piece(stat, i) for i in range(len(pieces))]
    if stat in ("min", "max"):  # these skip nulls, so every piece is asked for
        complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
        return F.when(complete, (F.least if stat == "min" else F.greatest)(*values))
    means = values if stat == "mean" else [piece("mean", i) for i in range(len(pieces))]
    mean = sum((m * float(k) for m, k in zip(means, pieces)), F.lit(0.0)) / float(n)
    if stat == "mean":
        return mean
    # Sums of squared deviations add up with the spread between the pieces' means.
    return sum((v + float(k) * (m - mean) * (m - mean) for v, m, k in zip(values, means, pieces)), F.lit(0.0))


def rolling_names() -> dict[str, tuple[str, str, int]]:
    """Feature name -> (statistic, column, rows) of every rolling feature."""
    out = {}
    for c in CORE3:
        for n in (*ROLLS, *(LONG_LAGS if c in LONG2 else ())):
            out |= {f"{c}_avg_{n}m": ("mean", c, n), f"{c}_std_{n}m": ("m2", c, n)}
            if n in ROLLS:
                out |= {f"{c}_min_{n}m": ("min", c, n), f"{c}_max_{n}m": ("max", c, n)}
    out |= {f"rain_last_{n}m": ("max", "rain_flag", n) for n in (15, 30, 60, 120)}
    return out | {f"rain_frac_{n}m": ("mean", "rain_flag", n) for n in (5, 10, 30, 60)}


def add_rolling(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Rolling features among ``wanted``; sample deviation, null until the window is full."""
    targets = {n: spec for n, spec in rolling_names().items() if n in wanted}
    pieces = {n: p for level in LADDER for n, p in level.items()}
    needed: set[tuple] = set()

    def need(stat: str, c: str, n: int) -> None:
        if (stat, c, n) in needed:
            return
        needed.add((stat, c, n))
        for k in set(pieces.get(n, ())):
            need(stat, c, k)
            if stat == "m2":
                need("mean", c, k)

    for spec in targets.values():
        need(*spec)
    base = {_part(s, c, n): _base_stat(s, c) for s, c, n in sorted(needed) if n == BASE}
    df = df.withColumns(base) if base else df
    for level in LADDER:
        cols = {_part(s, c, n): _joined(s, c, n, level[n]) for s, c, n in sorted(needed) if n in level}
        df = df.withColumns(cols) if cols else df
    final = {
        name: F.sqrt(F.col(_part(s, c, n)) / float(n - 1)) if s == "m2" else F.col(_part(s, c, n))
        for name, (s, c, n) in targets.items()}
    return df.withColumns(final).drop(*[_part(*x) for x in needed]) if final else df


def rain_slopes() -> Recipe:
    return {f"rain_slope_{n}m": lambda n=n: _change(f"rain_frac_{n}m", n) for n in (5, 10, 30)}


def slope_columns(cols: Sequence[str], windows: Sequence[int]) -> Recipe:
    return {f"{c}_slope_{n}m": lambda c=c, n=n: _slope(c, n) for n in windows for c in cols}


def rate_columns() -> Recipe:
    return {f"{c}_roc_{n}m": lambda c=c, n=n: _change(c, n) / n for c in CORE3 for n in (15, 30, 60)}


def momentum_columns() -> Recipe:
    return {
        "pressure_accel_30m": lambda: _change("pressure_delta_30m", 30),
        "dewpoint_gap_delta_30m": lambda: _change("temp_dewpoint_gap", 30),
        "dew_point_delta_30m": lambda: _change("dew_point", 30),
    }


def light_columns() -> Recipe:
    out = {}
    for n in (5, 10, 30):
        out[f"light_drop_vs_expected_{n}m"] = lambda n=n: _bright(_change("clear_sky_light_ratio", n))
        out[f"light_slope_{n}m"] = lambda n=n: _bright(_change("light", n) / float(n))
    return out


def with_light(df: DataFrame) -> DataFrame:
    """Availability, clear-sky ratio and daylight gate; a zero reading stays a reading."""
    raw = F.col("light") if "light" in df.columns else F.lit(None)
    df = df.withColumn("_lux", raw.try_cast("double")).withColumn("solar_elevation_deg", solar_elevation(F.col("ts")))
    have = F.col("_lux").isNotNull().cast("double")
    light = F.greatest(F.coalesce(F.col("_lux"), F.lit(0.0)), F.lit(0.0))
    daylight = have * (F.col("solar_elevation_deg") > 5.0).cast("double")
    expected = clear_sky_light(F.col("solar_elevation_deg"))
    ratio = clip(light / F.when(expected != 0.0, expected), 0.0, 1.5)
    return df.withColumns({
        "light": light,
        "light_available": have,
        "light_missing": 1.0 - have,
        "daylight_available": daylight,
        "clear_sky_light_ratio": F.when(daylight > 0.0, F.coalesce(ratio, F.lit(0.0))).otherwise(0.0),
    }).drop("_lux")


def _as_number(df: DataFrame, name: str) -> Column:
    """Optional input as a double: booleans and words become 1/0, compass points degrees."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("double")
    if isinstance(kind, T.StringType):
        return compass_degrees(F.col(name)) if name == "wind_direction" else truth_value(F.col(name))
    return F.col(name).cast("double")


def with_context(df: DataFrame) -> DataFrame:
    """Radar, cloud, wind and NWP context with explicit availability columns."""
    raw = {c: _as_number(df, c) for c in OPTIONAL_DEFAULTS}
    have_wind = F.coalesce(raw["wind_available"], raw["wind_speed"].isNotNull().cast("double"))
    have_nwp = F.coalesce(raw["nwp_available"], raw["nwp_precipitation_probability"].isNotNull().cast("double"))
    filled = {c: F.coalesce(raw[c], F.lit(d)) for c, d in OPTIONAL_DEFAULTS.items()}
    filled |= {"wind_available": have_wind, "nwp_available": have_nwp}
    for c in ("radar_available", "cloud_available", "wind_available", "nwp_available"):
        filled[c] = clip(filled[c], 0.0, 1.0)
    df = df.withColumns(filled)

    wind, nwp = F.col("wind_available") > 0.0, F.col("nwp_available") > 0.0

    def gated(flag: Column, value: Column, otherwise: float = 0.0) -> Column:
        return F.when(flag, value).otherwise(otherwise)

    def low(c: str) -> Column:
        return F.greatest(F.col(c), F.lit(0.0))

    angle = F.radians(modulo(F.col("wind_direction"), 360.0))
    nwp_angle = F.radians(modulo(F.col("nwp_wind_direction"), 360.0))
    speed = gated(wind, low("wind_speed"))
    nwp_speed = gated(nwp, low("nwp_wind_speed"))
    missing = {f"{s}_missing": (F.col(f"{s}_available") <= 0.0).cast("double") for s in ("radar", "cloud", "wind", "nwp")}
    return df.withColumns(missing | {
        "wind_speed_now": speed,
        "wind_gust_now": gated(wind, low("wind_gust")),
        "wind_u_now": -speed * F.sin(angle),
        "wind_v_now": -speed * F.cos(angle),
        "wind_direction_sin": gated(wind, F.sin(angle)),
        "wind_direction_cos": gated(wind, F.cos(angle)),
        "nwp_precipitation_probability_now": gated(nwp, clip(F.col("nwp_precipitation_probability"), 0.0, 100.0)),
        "nwp_precipitation_now": gated(nwp, low("nwp_precipitation")),
        "nwp_weathercode_now": gated(nwp, low("nwp_weathercode")),
        "nwp_wind_speed_now": nwp_speed,
        "nwp_wind_u_now": -nwp_speed * F.sin(nwp_angle),
        "nwp_wind_v_now": -nwp_speed * F.cos(nwp_angle),
        "nwp_cloud_cover_now": gated(nwp, clip(F.col("nwp_cloud_cover"), 0.0, 100.0)),
        "nwp_lead_hours_now": gated(nwp, low("nwp_lead_hours")),
        "nwp_age_seconds_now": gated(nwp, low("nwp_age_seconds"), 999999.0),
    })


def with_calendar(df: DataFrame) -> DataFrame:
    hour_sin, hour_cos = cyclic(F.hour("ts"), 24)
    day_sin, day_cos = cyclic(F.weekday("ts"), 7)
    return df.withColumns({"hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos})


STATIC = [
    "temp", "humidity", "pressure", "dew_point", "temp_dewpoint_gap", "rain_now",
    "hour_sin", "hour_cos", "day_sin", "day_cos",
    "radar_available", "radar_missing", "cloud_available", "cloud_missing",
    "radar_point_intensity", "radar_nearby_max_intensity", "radar_trend_rising",
    "cloud_cover_now", "cloud_cover_low_now", "cloud_trend_rising",
    "wind_available", "wind_missing", "wind_speed_now", "wind_gust_now",
    "wind_u_now", "wind_v_now", "wind_direction_sin", "wind_direction_cos",
    "nwp_available", "nwp_missing", "nwp_precipitation_probability_now", "nwp_precipitation_now",
    "nwp_weathercode_now", "nwp_wind_speed_now", "nwp_wind_u_now", "nwp_wind_v_now",
    "nwp_cloud_cover_now", "nwp_lead_hours_now", "nwp_age_seconds_now",
]
LIGHT_STATIC = [
    "light_available", "light_missing", "light", "solar_elevation_deg", "daylight_available", "clear_sky_light_ratio",
]


def feature_names() -> list[str]:
    """All feature columns; the order is the schema version of a model bundle."""
    names = [*STATIC, *LIGHT_STATIC]
    for c in CORE3:
        for n in (*LAGS, *(LONG_LAGS if c in LONG2 else ())):
            names += [f"{c}_{n}m_ago", f"{c}_delta_{n}m", f"{c}_trend_{n}m"]
        names += [f"{c}_{s}_{n}m" for n in ROLLS for s in ("avg", "std", "min", "max")]
        names += [f"{c}_slope_{n}m" for n in (5, 10, 30)] + [f"{c}_roc_{n}m" for n in (15, 30, 60)]
    names += [f"{c}_{s}_{n}m" for c in LONG2 for n in LONG_LAGS for s in ("avg", "std")]
    names += [f"{c}_slope_{n}m" for c in ("wind_speed", "wind_gust") for n in (10, 30, 60)]
    names += [f"rain_last_{n}m" for n in (15, 30, 60, 120)] + [f"rain_frac_{n}m" for n in (5, 10, 30, 60)]
    names += [f"rain_slope_{n}m" for n in (5, 10, 30)]
    names += [f"{k}_{n}m" for n in (5, 10, 30) for k in ("light_drop_vs_expected", "light_slope")]
    return [*names, "pressure_accel_30m", "dewpoint_gap_delta_30m", "dew_point_delta_30m"]


def onset_feature_names(names: Sequence[str] | None = None) -> list[str]:
    """Features allowed for onset models: nothing derived from the rain sensor."""
    return [n for n in (names or feature_names()) if n not in RAIN_DERIVED and not n.startswith("rain_")]


def check_onset_features(names: Sequence[str]) -> None:
    leaked = [n for n in names if n not in set(onset_feature_names(names))]
    if leaked:
        raise ValueError(f"onset inputs hold rain-derived features: {leaked[:5]}")


def missing_features(df: DataFrame, names: Sequence[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


def first_level() -> Recipe:
    return (
        slope_columns(CORE3, (5, 10, 30)) | slope_columns(("wind_speed", "wind_gust"), (10, 30, 60))
        | rate_columns() | light_columns()
    )


def add_pointwise(df: DataFrame, wanted: set[str]) -> DataFrame:
    """Features that need no other row, and what the others among ``wanted`` are built from."""
    if any("dew" in n for n in wanted):
        df = df.withColumns({
            "dew_point": dew_point(F.col("temp"), F.col("humidity")),
            "temp_dewpoint_gap": F.col("temp") - dew_point(F.col("temp"), F.col("humidity"))})
    if any(n.startswith(("radar", "cloud", "wind", "nwp")) for n in wanted):
        df = with_context(df)
    if any("light" in n or "solar" in n for n in wanted):
        df = with_light(df)
    if wanted & {"hour_sin", "hour_cos", "day_sin", "day_cos"}:
        df = with_calendar(df)
    if "rain_now" in wanted:
        df = df.withColumn("rain_now", F.col("rain_flag"))
    return df


def add_features(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Features on a repaired, chunked, segmented frame (``_us``, ``_chunk``, ``_seg``).

    ``names`` limits the work to those columns and what they are built from.
    """
    second = rain_slopes() | momentum_columns()
    wanted = set(names or feature_names())
    inputs = {f"rain_frac_{n}m" for n in (5, 10, 30) if f"rain_slope_{n}m" in wanted}
    if "pressure_accel_30m" in wanted:
        inputs.add("pressure_delta_30m")
    df = add_lags(df, wanted | inputs)
    first = {n: make() for n, make in first_level().items() if n in wanted | inputs}
    then = {n: make() for n, make in second.items() if n in wanted}
    df = add_pointwise(df, wanted)
    df = add_rolling(df, wanted | inputs)
    if first:
        df = df.withColumns(first)
    return df.withColumns(then) if then else df


def feature_reach(cadence: Cadence = Cadence()) -> float:
    """Seconds of past that ``CONTEXT_ROWS`` rows of one segment can span after repair."""
    return CONTEXT_ROWS * cadence.fill_over


def feature_frame(
    readings: DataFrame, names: Sequence[str] | None = None, cadence: Cadence = Cadence(), after: float = 0.0
) -> DataFrame:
    """Repaired readings with their features (all 202 by default); one shuffle on (station, chunk)."""
    df = repaired_chunks(readings, before=feature_reach(cadence), after=after, cadence=cadence)
    return core_only(add_features(df, names)).drop(US, CHUNK, SEG, "_start")


def labelled_features(readings: DataFrame, horizons: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    """Features and future labels side by side, still from the one shuffle of the repair.

    Adds ``rain_<h>m``, ``onset_<h>m`` and ``temp_ahead_30m`` to the feature frame,
    whose windowed features are made as arrays of a chunk (:mod:`.arrays`).
    """
    from . import arrays
    from .labels import LabelRule, future_onset, future_rain, label_reach, onset_flag
    from .segments import FILLED

    rule = LabelRule()
    df = repaired_chunks(readings, before=feature_reach(), after=label_reach(max(*horizons, 30), rule))
    df = df.withColumn("onset", onset_flag(df, rule))
    labels = {f"rain_{h}m": future_rain(df, h, rule) for h in horizons}
    labels |= {f"onset_{h}m": future_onset(df, h, "onset", rule) for h in horizons}
    labels["temp_ahead_30m"] = F.when(F.lead(FILLED, 30).over(segment_window()) == 0, F.lead("temp", 30).over(segment_window()))
    return arrays.add_features(df.withColumns(labels), names or feature_names()).drop(US, CHUNK, SEG, "_start")
