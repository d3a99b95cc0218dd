"""Unit normalisation and text-to-value expressions for reported sensor states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compass points clockwise from north, 22.5 degrees apart.
COMPASS = ("n", "nne", "ne", "ene", "e", "ese", "se", "sse", "s", "ssw", "sw", "wsw", "w", "wnw", "nw", "nnw")
# Words of a wet and of a dry contact, and of no value.
WET_WORDS = ("on", "true", "yes", "open", "wet", "raining", "rain")
DRY_WORDS = ("off", "false", "no", "closed", "dry", "clear", "not raining")
NO_VALUE = ("", "unknown", "unavailable", "none", "null")
# Unit spellings with (shift, multiplier, divisor):
# (value + shift) * multiplier / divisor.
TEMPERATURE_UNITS = (
    (("°c", "c", "ºc", ""), 0.0, 1.0, 1.0),
    (("°f", "f", "ºf"), -32.0, 5.0, 9.0),
    (("k", "°k", "ºk"), -273.15, 1.0, 1.0),
)
PRESSURE_UNITS = (
    (("hpa", "mbar", "mb", "hectopascal", "hectopascals", ""), 0.0, 1.0, 1.0),
    (("pa", "pascal", "pascals"), 0.0, 1.0, 100.0),
    (("kpa", "kilopascal", "kilopascals"), 0.0, 10.0, 1.0),
    (("inhg", "in hg", "in"), 0.0, 33.8638866667, 1.0),
)
WIND_UNITS = (
    (("m/s", "mps", "ms", "ms-1", "meter/second", "metre/second", ""), 0.0, 1.0, 1.0),
    (("km/h", "kmh", "kph", "kmph"), 0.0, 1.0, 3.6),
    (("mph", "mi/h", "mile/h", "miles/h"), 0.0, 0.44704, 1.0),
    (("kn", "knot", "knots", "kt"), 0.0, 0.5144444444, 1.0),
)
# Spellings of units.
PERCENT_UNITS = ("%", "percent", "percentage", "")
RATIO_UNITS = ("ratio", "fraction", "1")


#: Digits with an optional sign, point and exponent; the cast alone would take type suffixes such as 1d.
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def word(col: Column) -> Column:
    return F.lower(F.trim(col.cast("string")))


def number(state: Column) -> Column:
    """Finite number or null."""
    text = F.trim(state.cast("string"))
    value = F.when(text.rlike(NUMERIC), text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def between(value: Column, low: float, high: float) -> Column:
    return F.when((value >= low) & (value <= high), value)


def _convert(state: Column, unit: Column, table, low: float, high: float) -> Column:
    value, spelled = number(state), F.coalesce(word(unit), F.lit(""))
    out = F.lit(None).cast("double")
    for names, shift, times, over in reversed(table):
        out = F.when(spelled.isin(*names), (value + shift) * times / over).otherwise(out)
    return between(out, low, high)


def celsius(state: Column, unit: Column) -> Column:
    return _convert(state, unit, TEMPERATURE_UNITS, -100.0, 80.0)


def hectopascal(state: Column, unit: Column) -> Column:
    return _convert(state, unit, PRESSURE_UNITS, 700.0, 1100.0)


def metres_per_second(state: Column, unit: Column) -> Column:
    return _convert(state, unit, WIND_UNITS, 0.0, 100.0)


def humidity_percent(state: Column, unit: Column) -> Column:
    value, spelled = number(state), F.coalesce(word(unit), F.lit(""))
    scaled = F.when(spelled.isin(*RATIO_UNITS) & value.between(0.0, 1.0), value * 100.0)
    known = spelled.isin(*PERCENT_UNITS, *RATIO_UNITS)
    return between(F.when(known, F.coalesce(scaled, value)), 0.0, 100.0)


def _compass_map() -> Column:
    pairs = [F.lit(x) for i, p in enumerate(COMPASS) for x in (p, 22.5 * i)]
    return F.create_map(*pairs)


def compass_degrees(state: Column) -> Column:
    """Number as is, or one of the sixteen compass points."""
    return F.coalesce(number(state), F.try_element_at(_compass_map(), word(state)))


def wind_degrees(state: Column) -> Column:
    return between(compass_degrees(state), 0.0, 360.0)


def truth_value(state: Column) -> Column:
    """true/yes/1 -> 1.0, false/no/0 -> 0.0, else null."""
    w = word(state)
    return F.when(w.isin("true", "yes", "1"), 1.0).when(w.isin("false", "no", "0"), 0.0)


def rain_amount(state: Column) -> Column:
    w = word(state)
    return F.coalesce(number(state), F.when(w.isin(*WET_WORDS), 1.0).when(w.isin(*DRY_WORDS), 0.0))


def rain_wet(state: Column, threshold: float = 0.1) -> Column:
    """Wet flag; null where the state says nothing."""
    return rain_amount(state) > threshold


def is_contact_word(state: Column) -> Column:
    """On/off states hold until they change, so their age does not make them stale."""
    return F.coalesce(word(state).isin(*WET_WORDS, *DRY_WORDS), F.lit(False))


def light_text(state: Column) -> Column:
    """Reported light as text (a number or a word), null where nothing was reported."""
    n = number(state)
    text = F.when(~word(state).isin(*NO_VALUE), state.cast("string"))
    return F.coalesce(n.cast("string"), text)


def observed_at(*stamps: Column) -> Column:
    return F.coalesce(*stamps)


def age_seconds(now: Column, observed: Column) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(observed)) / 1e6
    return F.when(observed.isNotNull(), F.greatest(F.lit(0.0), age))


def utc_timestamp(text: Column) -> Column:
    """ISO text with ``Z``, an offset, or none (taken as UTC); null when unreadable.

    Needs the session zone UTC so that naive text is read as UTC.
    """
    return F.trim(text).try_cast("timestamp")


def sky_condition(raining: Column, cloud: Column, daytime: Column) -> Column:
    clear = F.when(daytime, "sunny").otherwise("clear-night")
    wet = F.when(F.coalesce(cloud, F.lit(0.0)) >= 90, "pouring").otherwise("rainy")
    dry = (
        F.when(cloud.isNull(), clear).when(cloud >= 85, "cloudy").when(cloud >= 30, "partlycloudy").otherwise(clear)
    )
    return F.when(raining, wet).otherwise(dry)


def overcast(cloud: Column) -> Column:
    return F.coalesce(cloud >= 70, F.lit(False))


# Forecast weather codes and their words.
WEATHER_WORDS = {
    0: "ท้องฟ้าแจ่มใส", 1: "แจ่มใสเป็นส่วนใหญ่", 2: "มีเมฆบางส่วน", 3: "มีเมฆมาก",
    45: "หมอก", 48: "หมอกน้ำแข็ง",
    51: "ฝนละอองเบา", 53: "ฝนละออง", 55: "ฝนละอองหนัก",
    61: "ฝนตกเล็กน้อย", 63: "ฝนตกปานกลาง", 65: "ฝนตกหนัก",
    80: "ฝนซู่เล็กน้อย", 81: "ฝนซู่ปานกลาง", 82: "ฝนซู่หนัก",
    95: "พายุฝนฟ้าคะนอง", 96: "พายุฝนฟ้าคะนองมีลูกเห็บ", 99: "พายุฝนฟ้าคะนองมีลูกเห็บหนัก",
}


def weather_words(code: Column) -> Column:
    pairs = [F.lit(x) for kv in WEATHER_WORDS.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), code.cast("int"))
    return F.when(code.isNotNull(), F.coalesce(known, F.concat(F.lit("code "), code.cast("int").cast("string"))))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
