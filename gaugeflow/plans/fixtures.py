"""Station-shaped views over the driver's tables, for Spark and for DuckDB.

The events of each station are laid on a jittered minute grid with planted
bursts, short gaps and long gaps; everything else is derived from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import KEY, ordinal, with_chunk
from ..policy import HOUR, MINUTE, SECOND

EPOCH = "2024-01-01 00:00:00"
EPOCH_US = 1_704_067_200 * SECOND


_SCHEMAS: dict = {}  # parquet footers are read once per table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias(KEY), "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")
    )
    e = ordinal(with_chunk(e, MINUTE), [KEY], ["ts", "event_id"], "rn")
    e = e.withColumn("b", F.expr("case when rn % 211 = 0 then rn - 1 else rn end"))
    offset = F.expr(
        "b*60 + (b*37) % 21 - 10 + case when rn % 211 = 0 then 3 else 0 end"
        " + (b div 97)*240 + (b div 500)*3600"
    )
    return e.select(
        F.col(KEY).cast("long").alias(KEY),
        F.col("rn").cast("long").alias("rn"),
        F.timestamp_micros(F.lit(EPOCH_US) + offset * SECOND).alias("ts"),
        (F.lit(20.0) + F.col("value") % 15.0).alias("temp"),
        (F.lit(50.0) + F.col("event_id") % 50).cast("double").alias("humidity"),
        (F.lit(1000.0) + (F.col("event_id") % 23) / 2.0).alias("pressure"),
        F.expr("case when event_type = 'error' and (rn div 40) % 4 = 0 then 1.0D else 0.0D end").alias("rain_flag"),
        F.expr("case when event_id % 5 = 0 then null else (event_id % 90) * 1000.0D end").alias("light"),
        F.expr("case when event_id % 7 = 0 then null else value % 12.0D end").alias("wind_speed"),
        F.expr("(event_id * 13 % 360) * 1.0D").alias("wind_direction"),
    )


READINGS = """
f1_o as (select cast(user_id%4 as bigint) as station_id, event_id, event_type, value,
                row_number() over (partition by user_id%4 order by ts, event_id) as rn from events),
f1_k as (select *, case when rn%211=0 then rn-1 else rn end as b from f1_o),
readings as (select station_id, rn,
       timestamp '2024-01-01 00:00:00' + to_seconds(b*60 + (b*37)%21 - 10
         + case when rn%211=0 then 3 else 0 end + (b//97)*240 + (b//500)*3600) as ts,
       20.0::double + value%15 as temp, (50.0 + (event_id%50))::double as humidity,
       (1000.0 + (event_id%23)/2.0)::double as pressure,
       case when event_type='error' and (rn//40)%4=0 then 1.0::double else 0.0::double end as rain_flag,
       case when event_id%5=0 then null else ((event_id%90)*1000.0)::double end as light,
       case when event_id%7=0 then null else value%12 end as wind_speed,
       ((event_id*13%360)*1.0)::double as wind_direction
from f1_k)
"""


def forecast_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    local = r.filter("rn % 7 = 0").withColumn("lead_minutes", F.explode(F.array(*[F.lit(k) for k in (5, 10, 30)]))).select(
        KEY, "ts", "lead_minutes", F.expr("((rn*31 + lead_minutes*17) % 100) / 100.0D").alias("rain_prob"),
        F.lit("local_rf").alias("source_layer"),
    )
    radar = r.filter("rn % 29 = 0").select(
        KEY, "ts", F.expr("cast(5 + 5*(rn % 5) as int)").alias("lead_minutes"),
        F.expr("((rn*19) % 100) / 100.0D").alias("rain_prob"), F.lit("radar_advection").alias("source_layer"),
    )
    return local.unionByName(radar).select(
        KEY, F.col("ts").alias("issued_at"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("lead_minutes").cast("long") * MINUTE).alias("valid_at"),
        "lead_minutes", "rain_prob", "source_layer",
    )


FORECASTS = """
forecast_log as (
select station_id, ts as issued_at, ts + to_minutes(lead) as valid_at, lead as lead_minutes,
       (((rn*31+lead*17)%100)/100.0)::double as rain_prob, 'local_rf' as source_layer
from readings cross join (values (5),(10),(30)) l(lead) where rn%7=0
union all
select station_id, ts, ts + to_minutes(5+5*(rn%5)), 5+5*(rn%5), (((rn*19)%100)/100.0)::double, 'radar_advection'
from readings where rn%29=0)
"""


def nwp_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = readings(spark, sf_dir).select(KEY, F.date_trunc("hour", "ts").alias("issued_hour")).distinct()
    return h.withColumn("lead_hours", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(
        KEY, "issued_hour",
        F.timestamp_micros(F.unix_micros("issued_hour") + F.col("lead_hours").cast("long") * HOUR).alias("valid_at"),
        "lead_hours",
        F.expr(f"24.0D + ((hour(issued_hour)*7 + lead_hours*3 + {KEY}) % 50) / 10.0D").alias("temp_forecast"),
        F.expr("cast((hour(issued_hour)*11 + lead_hours*5) % 101 as double)").alias("precipitation_probability"),
    )


NWP = """
f3_h as (select distinct station_id, date_trunc('hour', ts) as issued_hour from readings),
nwp_log as (
select station_id, issued_hour, issued_hour + to_hours(lead) as valid_at, cast(lead as int) as lead_hours,
       (24+((hour(issued_hour)*7+lead*3+station_id)%50)/10.0)::double as temp_forecast,
       ((hour(issued_hour)*11+lead*5)%101)::double as precipitation_probability
from f3_h cross join (select unnest(range(0,7)) as lead))
"""

# Burst-free readings segmented by the feature rule, then any-rain labels at {H} minutes.
KEPT = """
kept as (select * exclude nxt from (select *, lead(ts) over (partition by station_id order by ts, rn) nxt from readings)
         where nxt is null or epoch_us(nxt)-epoch_us(ts) > 5000000),
seg as (select *, sum(case when gap_us<20000000 or gap_us>630000000 then 1 else 0 end)
               over (partition by station_id order by ts) as segment_id
        from (select *, epoch_us(ts)-epoch_us(lag(ts) over (partition by station_id order by ts)) as gap_us from kept))
"""


def predictions_sql(horizon: int) -> str:
    h = horizon
    return f"""
lab{h} as (select *, max(rain_flag) over w as fmax, count(*) over w as fcnt,
             epoch_us(lead(ts,{h}) over (partition by station_id,segment_id order by ts)) - epoch_us(ts) as el
      from seg window w as (partition by station_id,segment_id order by ts rows between 1 following and {h} following)),
pred{h} as (select station_id, ts, rn, rain_flag, {h} as horizon, case when fmax>0.1 then 1 else 0 end as observed,
       least(1.0::double, (0.5*(case when fmax>0.1 then 1 else 0 end) + ((rn*13+{h})%50)/100.0)::double) as probability
from lab{h} where fcnt={h} and abs(el-{h}*60000000)<=30000000)
"""


def predictions(spark: SparkSession, sf_dir: str, *horizons: int) -> DataFrame:
    """Labelled rows of each horizon with a deterministic probability, gaps left unfilled; labelled in one pass."""
    from ..operators.labels import future_rain_rows

    rows = future_rain_rows(readings(spark, sf_dir), horizons)
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"future_rain_{h}m").cast("int").alias("observed")) for h in horizons])
    rows = rows.select(KEY, "ts", "rn", "rain_flag", F.explode(F.filter(each, lambda e: e["observed"].isNotNull())).alias("e"))
    share = F.least(F.lit(1.0), 0.5 * F.col("e.observed") + ((F.col("rn") * 13 + F.col("e.horizon")) % 50) / 100.0)
    return rows.select(KEY, "ts", "rn", "rain_flag", "e.horizon", "e.observed", share.alias("probability"))


def with_ctes(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes)


# Context that a station may report: words, flags, numbers, gaps, values out of range. Written once for both engines.
_CONTEXT = {
    "radar_available": "case rn%7 when 0 then 'yes' when 1 then ' TRUE ' when 2 then 'no' when 3 then '0' when 4 then 'maybe' when 5 then null else '1' end",
    "radar_point_intensity": "case when rn%9<>4 then (rn%5)*1.0 end", "radar_nearby_max_intensity": "case when rn%11<>4 then (rn%6)*1.0-1.0 end",
    "radar_trend_rising": "case when rn%6<>0 then rn%4=1 end",
    "cloud_available": "case when rn%13<>5 then (rn%9)*0.25-0.5 end", "cloud_cover_now": "case when rn%17<>3 then (rn*7%101)*1.0 end",
    "cloud_cover_low_now": "(rn*3%101)*1.0", "cloud_trend_rising": "case rn%5 when 0 then 'false' when 1 then 'true' when 2 then null else 'Yes' end",
    "wind_available": "case rn%4 when 0 then null when 1 then 1.0 when 2 then 0.0 else 1.5 end", "wind_gust": "case when rn%8<>3 then (rn%23)*1.0-2.0 end",
    "nwp_available": "case rn%5 when 0 then null when 1 then 0.0 else 1.0 end", "nwp_precipitation_probability": "case when rn%6<>1 then (rn*11%140)*1.0-20.0 end",
    "nwp_precipitation": "(rn%7)*0.5-0.5", "nwp_weathercode": "(rn%99)*1.0", "nwp_wind_speed": "(rn%9)*1.0-1.0", "nwp_wind_direction": "(rn*29%720)*1.0-360.0",
    "nwp_cloud_cover": "(rn%131)*1.0-10.0", "nwp_lead_hours": "(rn%12)*1.0-1.0", "nwp_age_seconds": "case when rn%7<>3 then (rn%50)*60.0-60.0 end",
}
_WORDS, _FLAGS = ("radar_available", "cloud_trend_rising"), ("radar_trend_rising",)


def context_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the optional radar, cloud, gust and forecast columns."""
    kind = {c: "string" if c in _WORDS else "boolean" if c in _FLAGS else "double" for c in _CONTEXT}
    return readings(spark, sf_dir).withColumns({c: F.expr(f"cast({e} as {kind[c]})") for c, e in _CONTEXT.items()})


def _blended(c: str) -> str:
    inside = f"coalesce({c}, {c}_2)" if c in _WORDS + _FLAGS else f"coalesce({c}+({c}_2-{c})*(slot/(n+1)), {c}, {c}_2)"
    return f"case when slot=0 then {c} else {inside} end as {c}"


# The same on the repaired series ``rseg``: xseg.
CONTEXT = f"""
cx1 as (select station_id, ts, {', '.join(f"({e})::{'varchar' if c in _WORDS else 'boolean' if c in _FLAGS else 'double'} as {c}" for c, e in _CONTEXT.items())} from kept),
cx2 as (select *, lead(ts) over w as ts2, {', '.join(f'lead({c}) over w as {c}_2' for c in _CONTEXT)} from cx1 window w as (partition by station_id order by ts)),
cx3 as (select *, epoch_us(ts2)-epoch_us(ts) as gap from cx2),
cx4 as (select *, case when gap>90000000 and gap<=630000000 then greatest(1, cast(round_even(gap/60000000.0,0) as int)-1) else 0 end as n from cx3),
cx5 as (select *, unnest(range(0, n+1)) as slot from cx4),
cx6 as (select station_id, make_timestamp(epoch_us(ts) + case when slot=0 then 0 else (gap*slot)//(n+1) end) as ts, {', '.join(map(_blended, _CONTEXT))} from cx5),
xseg as (select rseg.*, cx6.* exclude (station_id, ts) from rseg join cx6 using (station_id, ts))
"""
