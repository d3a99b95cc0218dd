"""Feature-family queries; together they cover every feature column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.chunks import KEY
from .fixtures import CONTEXT, context_readings, readings, with_ctes
from .registry import query, rd, sql_rd, ts_us
from .series import SERIES

W = "(partition by station_id, segment_id order by ts)"


def _frame(spark, sf, names=None, rows=readings):
    return X.feature_frame(rows(spark, sf).drop("rn"), names)


def _pick(spark, sf, names, rows=readings):
    return _frame(spark, sf, list(names), rows).select(KEY, ts_us("ts"), *[rd(n, 5).alias(n) for n in names])


def _sql(cols: dict[str, str], source: str = "rseg", ctes: tuple = SERIES) -> str:
    body = ", ".join(sql_rd(e, n, 5) for n, e in cols.items())
    return with_ctes(*ctes) + f"select station_id, epoch_us(ts) as ts_us, {body} from {source} window w as {W}"


def _lag_sql(cols, windows) -> dict[str, str]:
    out = {}
    for c in cols:
        for n in windows:
            out[f"{c}_{n}m_ago"] = f"lag({c},{n}) over w"
            out[f"{c}_delta_{n}m"] = out[f"{c}_trend_{n}m"] = f"{c} - lag({c},{n}) over w"
    return out


LAG = _lag_sql(X.CORE3, X.LAGS) | _lag_sql(X.LONG2, X.LONG_LAGS)


@query("feat_lag", _sql(LAG))
def feat_lag(spark, sf):
    return _pick(spark, sf, LAG)


def _roll_sql(fn: str, c: str, n: int) -> str:
    f = f"over (partition by station_id, segment_id order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({c}) {f} = {n} then {fn}({c}) {f} end"


SQL_FN = {"avg": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLL = {f"{c}_{s}_{n}m": _roll_sql(SQL_FN[s], c, n) for c in X.CORE3 for n in X.ROLLS for s in SQL_FN} | {
    f"{c}_{s}_{n}m": _roll_sql(SQL_FN[s], c, n) for c in X.LONG2 for n in X.LONG_LAGS for s in ("avg", "std")
}


@query("feat_roll", _sql(ROLL))
def feat_roll(spark, sf):
    return _pick(spark, sf, ROLL)


RAIN = {f"rain_last_{n}m": _roll_sql("max", "rain_flag", n) for n in (15, 30, 60, 120)} | {
    f"rain_frac_{n}m": _roll_sql("avg", "rain_flag", n) for n in (5, 10, 30, 60)
}
_RAIN_CTE = "rainy as (select *, " + ", ".join(f"{e} as {n}" for n, e in RAIN.items()) + " from rseg)"
RAIN_ALL = {n: n for n in RAIN} | {f"rain_slope_{n}m": f"rain_frac_{n}m - lag(rain_frac_{n}m,{n}) over w" for n in (5, 10, 30)}


@query("feat_rain", _sql(RAIN_ALL, "rainy", (*SERIES, _RAIN_CTE)))
def feat_rain(spark, sf):
    return _pick(spark, sf, RAIN_ALL)


def _slope(c: str, n: int) -> str:
    el = f"(epoch_us(ts) - lag(epoch_us(ts),{n}) over w)/60e6"
    return f"({c} - lag({c},{n}) over w) / case when {el} > 0 then {el} end"


_MORE_CTE = """more as (select *, temp-(100-humidity)/5 as dew_point, temp-(temp-(100-humidity)/5) as gap,
 coalesce(wind_speed,0.0) as ws, coalesce(wind_gust,0.0) as wg, pressure - lag(pressure,30) over w as pd30 from xseg window w as """ + W + ")"
RATE = (
    {f"{c}_slope_{n}m": _slope(c, n) for c in X.CORE3 for n in (5, 10, 30)}
    | {f"wind_speed_slope_{n}m": _slope("ws", n) for n in (10, 30, 60)}
    | {f"wind_gust_slope_{n}m": _slope("wg", n) for n in (10, 30, 60)}
    | {f"{c}_roc_{n}m": f"({c} - lag({c},{n}) over w)/{n}" for c in X.CORE3 for n in (15, 30, 60)}
    | {"dew_point": "dew_point", "temp_dewpoint_gap": "gap", "pressure_accel_30m": "pd30 - lag(pd30,30) over w",
       "dewpoint_gap_delta_30m": "gap - lag(gap,30) over w", "dew_point_delta_30m": "dew_point - lag(dew_point,30) over w"}
)


@query("feat_rate", _sql(RATE, "more", (*SERIES, CONTEXT, _MORE_CTE)))
def feat_rate(spark, sf):
    return _pick(spark, sf, RATE, context_readings)


SOLAR = """
so1 as (select *, hour(ts)+minute(ts)/60.0::double+second(ts)/3600.0::double as hh from rseg),
so2 as (select *, 2*pi()/365.0*(dayofyear(ts)-1.0+(hh-12.0)/24.0) as ga from so1),
so3 as (select *, 0.006918-0.399912*cos(ga)+0.070257*sin(ga)-0.006758*cos(2*ga)+0.000907*sin(2*ga)-0.002697*cos(3*ga)+0.00148*sin(3*ga) as decl,
  229.18*(0.000075+0.001868*cos(ga)-0.032077*sin(ga)-0.014615*cos(2*ga)-0.040849*sin(2*ga)) as eqt from so2),
so4 as (select *, radians((hh*60.0+eqt+4.0*100.5180519)/4.0-180.0) as ha from so3),
so5 as (select *, degrees(asin(greatest(-1.0,least(1.0, sin(radians(13.8692387))*sin(decl)
   + cos(radians(13.8692387))*cos(decl)*cos(ha))))) as el from so4),
so6 as (select *, case when light is null then 0.0 else 1.0 end::double as avail, greatest(coalesce(light,0.0),0.0) as lux,
   105000.0*power(greatest(sin(radians(el)),0.0),1.15) as expect from so5),
so7 as (select *, case when el>5.0 then avail else 0.0 end as dayl from so6),
so as (select *, case when dayl>0 then coalesce(least(1.5,greatest(0.0,lux/nullif(expect,0.0))),0.0) else 0.0 end as ratio from so7)
"""
LIGHT = {"light_available": "avail", "light_missing": "1.0-avail", "light": "lux", "solar_elevation_deg": "el",
         "daylight_available": "dayl", "clear_sky_light_ratio": "ratio"}
for _n in (5, 10, 30):
    LIGHT[f"light_drop_vs_expected_{_n}m"] = f"case when dayl>0 then coalesce(ratio-lag(ratio,{_n}) over w,0.0) else 0.0 end"
    LIGHT[f"light_slope_{_n}m"] = f"case when dayl>0 then coalesce((lux-lag(lux,{_n}) over w)/{_n}.0,0.0) else 0.0 end"


@query("feat_light", _sql(LIGHT, "so", (*SERIES, SOLAR)))
def feat_light(spark, sf):
    return _pick(spark, sf, LIGHT)


def _word(c):
    return f"coalesce(case when lower(trim({c})) in ('true','yes','1') then 1.0 when lower(trim({c})) in ('false','no','0') then 0.0 end, 0.0)"


def _bounded(e, low=0.0, high=None):
    return f"greatest({low}, {e})" if high is None else f"greatest({low}, least({high}, {e}))"


def _zero(c):
    return f"coalesce({c}, 0.0)"


def _angle(c):
    return f"radians((({c}%360)+360)%360)"


_RADAR, _CLOUD = _bounded(_word("radar_available"), 0.0, 1.0), _bounded(_zero("cloud_available"), 0.0, 1.0)
_WIND = _bounded("coalesce(wind_available, case when wind_speed is null then 0.0 else 1.0 end)", 0.0, 1.0)
_NWP = _bounded("coalesce(nwp_available, case when nwp_precipitation_probability is null then 0.0 else 1.0 end)", 0.0, 1.0)


def _if(flag, e, other="0.0"):
    return f"case when {flag} > 0 then {e} else {other} end"


_SPEED, _NSPEED = _if(_WIND, _bounded(_zero("wind_speed"))), _if(_NWP, _bounded(_zero("nwp_wind_speed")))
EXTERNAL = {
    "hour_sin": "sin(2*pi()*hour(ts)/24)", "hour_cos": "cos(2*pi()*hour(ts)/24)",
    "day_sin": "sin(2*pi()*(isodow(ts)-1)/7)", "day_cos": "cos(2*pi()*(isodow(ts)-1)/7)",
    "rain_now": "rain_flag",
    **{f"{name}_available": e for name, e in (("radar", _RADAR), ("cloud", _CLOUD), ("wind", _WIND), ("nwp", _NWP))},
    **{f"{name}_missing": f"case when {e} <= 0 then 1.0 else 0.0 end" for name, e in (("radar", _RADAR), ("cloud", _CLOUD), ("wind", _WIND), ("nwp", _NWP))},
    "radar_point_intensity": _zero("radar_point_intensity"), "radar_nearby_max_intensity": _zero("radar_nearby_max_intensity"),
    "radar_trend_rising": "case when radar_trend_rising then 1.0 else 0.0 end",
    "cloud_cover_now": _zero("cloud_cover_now"), "cloud_cover_low_now": _zero("cloud_cover_low_now"), "cloud_trend_rising": _word("cloud_trend_rising"),
    "wind_speed_now": _SPEED, "wind_gust_now": _if(_WIND, _bounded(_zero("wind_gust"))),
    "wind_u_now": f"-({_SPEED})*sin({_angle('wind_direction')})", "wind_v_now": f"-({_SPEED})*cos({_angle('wind_direction')})",
    "wind_direction_sin": _if(_WIND, f"sin({_angle('wind_direction')})"), "wind_direction_cos": _if(_WIND, f"cos({_angle('wind_direction')})"),
    "nwp_precipitation_probability_now": _if(_NWP, _bounded(_zero("nwp_precipitation_probability"), 0.0, 100.0)),
    "nwp_precipitation_now": _if(_NWP, _bounded(_zero("nwp_precipitation"))), "nwp_weathercode_now": _if(_NWP, _bounded(_zero("nwp_weathercode"))),
    "nwp_wind_speed_now": _NSPEED, "nwp_wind_u_now": f"-({_NSPEED})*sin({_angle('nwp_wind_direction')})", "nwp_wind_v_now": f"-({_NSPEED})*cos({_angle('nwp_wind_direction')})",
    "nwp_cloud_cover_now": _if(_NWP, _bounded(_zero("nwp_cloud_cover"), 0.0, 100.0)), "nwp_lead_hours_now": _if(_NWP, _bounded(_zero("nwp_lead_hours"))),
    "nwp_age_seconds_now": _if(_NWP, _bounded("coalesce(nwp_age_seconds, 999999.0)"), "999999.0"),
}


@query("feat_external", _sql(EXTERNAL, "xseg", (*SERIES, CONTEXT)))
def feat_external(spark, sf):
    return _pick(spark, sf, EXTERNAL, context_readings)


@query("feature_complete", with_ctes(*SERIES) + """
select station_id, count(*) as n, sum(case when rr > 120 then 1 else 0 end)::bigint as complete from
 (select *, row_number() over (partition by station_id, segment_id order by ts) as rr from rseg) group by 1""")
def feature_complete(spark, sf):
    """Rows on which all 202 features exist (needs 120 earlier rows of the segment)."""
    names = X.feature_names()
    lacking = F.array_contains(F.array(*[F.col(n).isNull() for n in names]), True)
    return _frame(spark, sf).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(lacking, 0).otherwise(1)).cast("long").alias("complete")
    )
