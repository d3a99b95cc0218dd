"""Repair and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from ..operators.chunks import KEY
from ..policy import AUDIT_GAPS, FEATURE_GAPS, RAIN_STOP_GAPS, Cadence
from .fixtures import READINGS, KEPT, readings, with_ctes
from .registry import query, rd, sql_rd, ts_us

# Burst-free readings, then one row per missing minute of each fillable gap.
REPAIRED = """
nx as (select *, lead(ts) over w as ts2, lead(temp) over w as temp2, lead(humidity) over w as humidity2,
              lead(pressure) over w as pressure2, lead(rain_flag) over w as rain2, lead(light) over w as light2,
              lead(wind_speed) over w as wind2, lead(wind_direction) over w as dir2, lead(rn) over w as rn2
       from kept window w as (partition by station_id order by ts)),
gp as (select *, epoch_us(ts2)-epoch_us(ts) as gap from nx),
ct as (select *, case when gap>90000000 and gap<=630000000
                 then greatest(1, cast(round_even(gap/60000000.0,0) as int)-1) else 0 end as n from gp),
sl as (select *, unnest(range(0, n+1)) as slot from ct),
repaired as (select station_id,
   make_timestamp(epoch_us(ts) + case when slot=0 then 0 else (gap*slot)//(n+1) end) as ts,
   case when slot=0 then temp else temp+(temp2-temp)*(slot/(n+1)) end as temp,
   case when slot=0 then humidity else humidity+(humidity2-humidity)*(slot/(n+1)) end as humidity,
   case when slot=0 then pressure else pressure+(pressure2-pressure)*(slot/(n+1)) end as pressure,
   case when slot=0 then rain_flag else greatest(rain_flag, rain2) end as rain_flag,
   case when slot=0 then light else coalesce(light+(light2-light)*(slot/(n+1)), light, light2) end as light,
   case when slot=0 then wind_speed else coalesce(wind_speed+(wind2-wind_speed)*(slot/(n+1)), wind_speed, wind2) end as wind_speed,
   case when slot=0 then wind_direction else wind_direction+(dir2-wind_direction)*(slot/(n+1)) end as wind_direction,
   case when slot>0 then 1.0 else 0.0 end::double as observation_gap_filled
 from sl),
rseg as (select *, sum(case when g<20000000 or g>630000000 then 1 else 0 end)
                   over (partition by station_id order by ts) as segment_id
         from (select *, epoch_us(ts)-epoch_us(lag(ts) over (partition by station_id order by ts)) as g from repaired))
"""
SERIES = (READINGS, KEPT, REPAIRED)


def repaired_series(spark, sf):
    return S.repaired_series(readings(spark, sf).drop("rn"))


@query("burst_collapse", with_ctes(READINGS, KEPT) + """
select station_id, epoch_us(ts) as ts_us, rn, round(temp,6)+0.0 as temp from kept""")
def burst_collapse(spark, sf):
    return S.collapse_bursts(readings(spark, sf)).select(KEY, ts_us("ts"), "rn", rd("temp").alias("temp"))


@query("gap_fill", with_ctes(*SERIES) + f"""
select station_id, epoch_us(ts) as ts_us, {sql_rd('temp','temp')}, {sql_rd('humidity','humidity')},
 {sql_rd('pressure','pressure')}, rain_flag, {sql_rd('light','light')}, {sql_rd('wind_speed','wind_speed')},
 {sql_rd('wind_direction','wind_direction')}, observation_gap_filled as filled from repaired""")
def gap_fill(spark, sf):
    df = S.fill_gaps(readings(spark, sf).drop("rn"))
    return df.select(
        KEY, ts_us("ts"), *[rd(c).alias(c) for c in ("temp", "humidity", "pressure")], "rain_flag",
        *[rd(c).alias(c) for c in ("light", "wind_speed", "wind_direction")], F.col(S.FILLED).alias("filled"),
    )


@query("segment_summary", with_ctes(*SERIES) + """
select station_id, cast(segment_id as bigint) as segment_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us,
 count(*) as n, cast(sum(observation_gap_filled) as bigint) as filled from rseg group by 1,2""")
def segment_summary(spark, sf):
    df = repaired_series(spark, sf)
    return df.groupBy(KEY, "segment_id").agg(
        F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"),
        F.count(F.lit(1)).alias("n"), F.sum(S.FILLED).cast("long").alias("filled"),
    )


def _rule_sql(source: str, low: float, high: float) -> str:
    return f"""
select station_id, epoch_us(ts) as ts_us, cast(sum(case when g<{low}*1000000 or g>{high}*1000000 then 1 else 0 end)
   over (partition by station_id order by ts) as bigint) as segment_id
from (select *, epoch_us(ts)-epoch_us(lag(ts) over (partition by station_id order by ts)) as g from {source})"""


@query("segments_audit", with_ctes(READINGS, KEPT) + f"""
select *, row_number() over (partition by station_id order by ts_us) - 1 as position from ({_rule_sql('kept', 20, 90)})""")
def segments_audit(spark, sf):
    from ..operators.chunks import ordinal, with_chunk

    df = S.segments(readings(spark, sf), AUDIT_GAPS, Cadence())
    df = ordinal(with_chunk(df), [KEY], ["ts"], "n")
    return df.select(KEY, ts_us("ts"), "segment_id", (F.col("n") - 1).alias("position"))


@query("segments_rain_stop", with_ctes(READINGS) + _rule_sql("readings", -1, 150))
def segments_rain_stop(spark, sf):
    return S.segments(readings(spark, sf), RAIN_STOP_GAPS).select(KEY, ts_us("ts"), "segment_id")


@query("segments_feature", with_ctes(READINGS, KEPT) + _rule_sql("kept", 20, 630))
def segments_feature(spark, sf):
    return S.segments(readings(spark, sf), FEATURE_GAPS, Cadence()).select(KEY, ts_us("ts"), "segment_id")


def _stations_sql(tail: str) -> str:
    return with_ctes(READINGS, "moved as (select station_id, rn, ts + ((select max(ts) from readings where station_id=0)"
                     " - max(ts) over (partition by station_id)) + to_seconds(station_id*140) as ts, temp, rain_flag from readings),"
                     "clock as (select max(ts) + to_seconds(390) as now_ts from moved where station_id=0)") + tail


def _moved(spark, sf):
    """Readings shifted so that the stations' newest rows lie 140 s apart."""
    r = readings(spark, sf).select(KEY, "rn", "ts", "temp", "rain_flag")
    last = r.groupBy(KEY).agg(F.max(F.unix_micros("ts")).alias("_last"))
    zero = last.filter(f"{KEY} = 0").select("_last").scalar()
    shift = last.select(KEY, (zero - F.col("_last") + F.col(KEY) * 140_000_000).alias("_shift"))
    moved = r.join(shift, KEY).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("_shift"))).drop("_shift")
    now_us = moved.filter(f"{KEY} = 0").agg(F.max(F.unix_micros("ts"))).scalar() + 390_000_000
    return moved, F.timestamp_micros(now_us)


TAIL_SQL = _stations_sql("""
, newest as (select m.*, epoch_us(now_ts)-epoch_us(ts) as age from moved m, clock
             where (station_id, ts) in (select (station_id, max(ts)) from moved group by station_id)),
tail as (select station_id, rn, ts + to_minutes(unnest(range(1, 1 + cast((age-20000000)//60000000 as bigint)))) as ts, temp, rain_flag
         from newest where age>180000000 and age<=600000000)
select station_id, epoch_us(ts) as ts_us, rn, round(temp,6)+0.0 as temp, 0.0::double as filled, 0.0::double as tail from moved
union all select station_id, epoch_us(ts), rn, round(temp,6)+0.0, 1.0, 1.0 from tail""")


@query("tail_extend", TAIL_SQL)
def tail_extend(spark, sf):
    df, now = _moved(spark, sf)
    return S.extend_tail(df, now).select(
        KEY, ts_us("ts"), "rn", rd("temp").alias("temp"), F.col(S.FILLED).alias("filled"), F.col(S.TAIL).alias("tail")
    )


@query("live_gate", _stations_sql("""
select station_id, epoch_us(ts) as newest_us, round((epoch_us(now_ts)-epoch_us(ts))/1e6,3)+0.0 as age_seconds,
  case when epoch_us(now_ts)-epoch_us(ts) > 600000000 or epoch_us(now_ts)-epoch_us(ts) < -60000000 then 'not_current'
       when nullif(rn % 2, 0) is null then 'insufficient_context' else 'ready' end as status
from moved, clock where (station_id, ts) in (select (station_id, max(ts)) from moved group by station_id)"""))
def live_gate(spark, sf):
    df, now = _moved(spark, sf)
    df = df.withColumn("odd", F.expr("nullif(rn % 2, 0)"))
    out = S.live_gate(df, now, ["temp", "odd"])
    return out.select(KEY, F.unix_micros("newest_ts").alias("newest_us"), rd("age_seconds", 3).alias("age_seconds"), "status")
