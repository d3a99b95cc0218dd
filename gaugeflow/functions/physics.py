"""Physical and calendar expressions; every function maps columns to a column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LATITUDE, LONGITUDE = 13.8692387, 100.5180519

# Heat index regression in Celsius and percent, as
# (coefficient, power of temperature, power of humidity).
HEAT_INDEX_TERMS = (
    (-8.78469475556, 0, 0), (1.61139411, 1, 0), (2.33854883889, 0, 1),
    (-0.14611605, 1, 1), (-0.012308094, 2, 0), (-0.0164248277778, 0, 2),
    (0.002211732, 2, 1), (0.00072546, 1, 2), (-0.000003582, 2, 2),
)
# Upper edges of the comfort classes.
COMFORT_CLASSES = ((27, "comfortable"), (32, "caution"), (41, "extreme_caution"), (54, "danger"))
COMFORT_TOP = "extreme_danger"
# Trend words (rising, falling, steady).
TREND_WORDS = ("ขึ้น ↑", "ลง ↓", "คงที่ →")
# Fourier series of solar declination (rad) and equation of time
# (before the 229.18 factor), as (coefficient, "cos"/"sin", harmonic).
DECLINATION = (0.006918, ((-0.399912, "cos", 1), (0.070257, "sin", 1), (-0.006758, "cos", 2),
                          (0.000907, "sin", 2), (-0.002697, "cos", 3), (0.00148, "sin", 3)))
EQUATION_OF_TIME = (0.000075, ((0.001868, "cos", 1), (-0.032077, "sin", 1),
                               (-0.014615, "cos", 2), (-0.040849, "sin", 2)))
EQUATION_SCALE = 229.18
CLEAR_SKY_LUX, CLEAR_SKY_POWER = 105000.0, 1.15


def heat_index(temp: Column, humidity: Column) -> Column:
    total = None
    for c, p, q in HEAT_INDEX_TERMS:
        term = F.lit(c)
        for _ in range(p):
            term = term * temp
        for _ in range(q):
            term = term * humidity
        total = term if total is None else total + term
    return F.when((temp >= 27.0) & (humidity >= 40.0), total).otherwise(temp)


def comfort_class(heat: Column) -> Column:
    out = F.lit(COMFORT_TOP)
    for edge, name in reversed(COMFORT_CLASSES):
        out = F.when(heat < edge, name).otherwise(out)
    return F.when(heat.isNotNull(), out)


def dew_point(temp: Column, humidity: Column) -> Column:
    return temp - (100 - humidity) / 5


def trend_word(hpa_per_hour: Column, band: float = 0.5) -> Column:
    rising, falling, steady = TREND_WORDS
    return F.when(hpa_per_hour > band, rising).when(hpa_per_hour < -band, falling).otherwise(steady)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip keeping nulls (plain least/greatest would skip them)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def _fourier(series, angle: Column) -> Column:
    constant, terms = series
    out = F.lit(constant)
    for c, kind, k in terms:
        wave = F.cos if kind == "cos" else F.sin
        out = out + F.lit(c) * wave(angle * F.lit(float(k)))
    return out


def solar_elevation(ts: Column, lat: float = LATITUDE, lon: float = LONGITUDE) -> Column:
    """Approximate solar elevation in degrees for a UTC timestamp (session zone UTC)."""
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    angle = F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - 1.0 + (hours - 12.0) / 24.0)
    decl = _fourier(DECLINATION, angle)
    minutes = hours * 60.0 + F.lit(EQUATION_SCALE) * _fourier(EQUATION_OF_TIME, angle) + 4.0 * lon
    hour_angle = F.radians(minutes / 4.0 - 180.0)
    lat_r = math.radians(lat)
    sine = F.lit(math.sin(lat_r)) * F.sin(decl) + F.lit(math.cos(lat_r)) * F.cos(decl) * F.cos(hour_angle)
    return F.degrees(F.asin(clip(sine, -1.0, 1.0)))


def clear_sky_light(elevation: Column) -> Column:
    return F.lit(CLEAR_SKY_LUX) * F.pow(F.greatest(F.sin(F.radians(elevation)), F.lit(0.0)), F.lit(CLEAR_SKY_POWER))


def modulo(value: Column, base: float) -> Column:
    """Floored modulo (result has the sign of the base)."""
    return F.pmod(value, F.lit(base))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / period
    return F.sin(angle), F.cos(angle)


def pressure_anomaly(value: Column, band: float = 0.5) -> Column:
    return F.when(value < -band, "below").when(value > band, "above").otherwise("near")
