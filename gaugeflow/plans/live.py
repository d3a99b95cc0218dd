"""Streaming queries, run over the data at hand and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.physics import comfort_class
from ..operators.chunks import KEY
from ..operators import segments as S
from ..operators.entities import fingerprint
from ..operators.lineage import fresh_path
from ..streaming import composed as CP
from ..streaming import ingest as I
from ..streaming import revisions as RV
from ..streaming import storage as SG
from ..streaming.bridge import EMITTED, bridge
from ..streaming.run import drain, file_stream, staged_stream
from .cleaning import HEAT_SQL
from .fixtures import FORECASTS, NWP, READINGS, forecast_log, readings, table, with_ctes
from .happenings import MACHINE, _GATE, _POLICY, _SIG, _polls, _recursive
from .outlooks import _HOURLY, _REVISION, _hourly
from .registry import query, rd, ts_us
from .series import TAIL_SQL, _moved


#: The tables at hand are complete and staged in event-time order, so no row need wait for later ones.
AT_ONCE = "0 seconds"
#: They are replayed a day of a station at a time.
REPLAY = 86_400.0


def _events_stream(spark, sf):
    """The events table as a file stream, with the columns of a reading."""
    schema = table(spark, sf, "events").schema
    e = file_stream(spark, sf, schema, pathGlobFilter="events.parquet")
    return e.select(
        (F.col("user_id") % 4).alias(KEY), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
        (20 + F.col("value") % 15).alias("temp"), (50.0 + F.col("event_id") % 50).alias("humidity"),
        (1000.0 + F.col("event_id") % 23 / 2.0).alias("pressure"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("rain_flag"))


@query("stream_dedupe", "select distinct user_id%4 as station_id, epoch_us(date_trunc('minute', ts)) as ts_us from events")
def stream_dedupe(spark, sf):
    return drain(I.unique_readings(_events_stream(spark, sf)), "dedupe").select(KEY, ts_us("ts"))


@query("stream_daily", f"""
with r as (select user_id%4 as station_id, date_trunc('minute', ts) as ts, 20+value%15 as temp, 50.0::double+event_id%50 as humidity, 1000.0::double+(event_id%23)/2.0 as pressure, event_type from events),
h as (select *, {HEAT_SQL} as hi from r)
select station_id, cast((ts + interval 7 hours)::date as varchar) as date, count(*) as count, round(min(temp),5)+0.0 as temp_min, round(max(temp),5)+0.0 as temp_max, round(avg(temp),5)+0.0 as temp_avg,
 count(*) filter (where event_type='error')::double as rain_minutes, round(max(hi),5)+0.0 as heat_index_max from h group by 1,2""")
def stream_daily(spark, sf):
    out = drain(I.summaries(_events_stream(spark, sf), offset="17 hours"), "daily", "update", [KEY, "start"])
    date = F.to_date(F.expr("start + interval 7 hours")).cast("string")
    return out.select(KEY, date.alias("date"), "count", "rain_minutes", *[rd(c, 5).alias(c) for c in ("temp_min", "temp_max", "temp_avg", "heat_index_max")])


@query("stream_weekly", """
with r as (select user_id%4 as station_id, date_trunc('minute', ts) as ts, 20+value%15 as temp from events),
d as (select r.*, date_trunc('day', ts) - to_days(k::int) as start from r cross join (select unnest(range(0,7)) as k))
select station_id, epoch_us(start) as start_us, count(*) as count, round(avg(temp),5)+0.0 as temp_avg from d group by 1,2""")
def stream_weekly(spark, sf):
    out = drain(I.summaries(_events_stream(spark, sf), "7 days", "1 day"), "weekly", "update", [KEY, "start"])
    return out.select(KEY, ts_us("start"), "count", rd("temp_avg", 5).alias("temp_avg"))


@query("stream_alerts", _recursive(READINGS, _SIG, _POLICY, _GATE.format(kind="kind")) + """
, sent as (select station_id, ts, string_agg(kind, ',' order by seq) as kinds from gt where ok group by 1,2)
select al.station_id, epoch_us(al.ts) as ts_us, rain as raining, mc>=3 as confirmed_alert, rc>=5 as confirmed_radar_alert, coalesce(kinds,'') as notifications
from al left join sent on sent.station_id=al.station_id and sent.ts=al.ts""")
def stream_alerts(spark, sf):
    out = CP.alerts(staged_stream(_polls(spark, sf), "polls", "ts", end=True), slot=REPLAY, delay=AT_ONCE, whole=True)
    return out.select(KEY, ts_us("ts"), "raining", "confirmed_alert", "confirmed_radar_alert", F.array_join("notifications", ",").alias("notifications"))


@query("stream_rain_sessions", _recursive(READINGS, MACHINE) + "select station_id, done_start as start_us, done_stop as stop_us from st where done_start is not null union all select station_id, cut_start, null from st where cut")
def stream_rain_sessions(spark, sf):
    stream = staged_stream(readings(spark, sf).select(KEY, "ts", "rain_flag"), "readings", "ts", end=True)
    return CP.rain_sessions(stream, slot=REPLAY, delay=AT_ONCE, whole=True)


@query("stream_repeats", with_ctes(READINGS) + """
, d as (select station_id, ts, rn, rain_flag, cast(floor(temp/4) as bigint) as t4 from readings),
l as (select *, lag(rain_flag) over (partition by station_id order by ts) as pr, lag(t4) over (partition by station_id order by ts) as pt, row_number() over (partition by station_id order by ts) as i from d)
select station_id, epoch_us(ts) as ts_us, rn from l where i=1 or pr<>rain_flag or pt<>t4""")
def stream_repeats(spark, sf):
    r = readings(spark, sf).select(KEY, "ts", "rn", "rain_flag", F.floor(F.col("temp") / 4).alias("t4"))
    stream = staged_stream(r.select(KEY, "ts", "rn", fingerprint("rain_flag", "t4", doubles=("rain_flag",)).alias("h")), "snapshots", "ts", end=True)
    return CP.without_repeats(stream, slot=REPLAY, delay=AT_ONCE, whole=True).select(KEY, ts_us("ts"), "rn")


@query("stream_outcomes", with_ctes(READINGS, FORECASTS) + """
select f.station_id, epoch_us(issued_at) as issued_us, lead_minutes::int as lead_minutes, source_layer, epoch_us(r.ts) as ts_us, r.rain_flag
from forecast_log f join readings r on r.station_id=f.station_id and r.ts between f.valid_at - interval 90 seconds and f.valid_at + interval 90 seconds""")
def stream_outcomes(spark, sf):
    f = staged_stream(forecast_log(spark, sf), "forecasts", "valid_at")
    r = staged_stream(readings(spark, sf).select(KEY, "ts", "rain_flag"), "readings", "ts")
    out = drain(I.outcomes(f, r), "outcomes", whole=True)
    return out.select(KEY, F.unix_micros("issued_at").alias("issued_us"), F.col("lead_minutes").cast("int").alias("lead_minutes"), "source_layer", ts_us("ts"), "rain_flag")


@query("stream_settled", with_ctes(READINGS, FORECASTS) + """
, wm as (select least((select max(epoch_us(valid_at)) from forecast_log), (select max(greatest(epoch_us(ts), (epoch_us(ts)+90000000)//600000000*600000000)) from readings)) // 1000 * 1000 - 7590000000 as us),
due as (select *, epoch_us(valid_at) as due_us from forecast_log, wm where (epoch_us(valid_at)//600000000+1)*600000000 <= wm.us),
near as (select d.station_id, d.issued_at, d.lead_minutes, d.source_layer, epoch_us(r.ts) as rus, r.rain_flag, abs(epoch_us(r.ts)-due_us) as dist,
   case epoch_us(r.ts)//60000000 - due_us//60000000 when 0 then 0 when -1 then 1 else 2 end as rank
  from due d join readings r on r.station_id=d.station_id and r.ts between d.valid_at - interval 90 seconds and d.valid_at + interval 90 seconds
   and abs(epoch_us(r.ts)//60000000 - due_us//60000000) <= 1),
best as (select * from near qualify row_number() over (partition by station_id, issued_at, lead_minutes, source_layer order by dist, rank, rus, rain_flag) = 1)
select d.station_id, epoch_us(d.issued_at) as issued_us, d.lead_minutes::int as lead_minutes, d.source_layer, b.rus as matched_us, b.rain_flag, case when b.rain_flag>0.1 then 1 when b.rain_flag is not null then 0 end as actual
from due d left join best b using (station_id, issued_at, lead_minutes, source_layer)""")
def stream_settled(spark, sf):
    f = staged_stream(forecast_log(spark, sf), "forecasts", "valid_at")
    r = staged_stream(readings(spark, sf).select(KEY, "ts", "rain_flag"), "readings", "ts")
    out = drain(I.settled_outcomes(f, r), "settled", whole=True)
    return out.select(
        KEY, F.unix_micros("issued_at").alias("issued_us"), F.col("lead_minutes").cast("int").alias("lead_minutes"), "source_layer",
        F.unix_micros("matched_at").alias("matched_us"), "rain_flag", "actual")


@query("stream_bridge", TAIL_SQL)
def stream_bridge(spark, sf):
    """What has come out of the bridge at the time of the clock."""
    df, now = _moved(spark, sf)
    now_ms = spark.range(1).select(F.unix_millis(now)).first()[0]
    stream = staged_stream(df.select(KEY, "rn", "ts", "temp"), "moved", "ts")
    out = drain(bridge(stream, clock=lambda _: now_ms), "bridged", machine=True, clock=True)
    return out.select(KEY, ts_us("ts"), "rn", rd("temp").alias("temp"), F.col(S.FILLED).alias("filled"), F.col(S.TAIL).alias("tail"))


@query("stream_stored", """
select user_id%4 as station_id, epoch_us(date_trunc('minute', ts)) as ts_us, min(event_id) as event_id, arg_min(event_type, event_id) as event_type
from events group by all""")
def stream_stored(spark, sf):
    """First arrivals, with readings that come in the order of their numbers."""
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 4).cast("long").alias(KEY), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"), "event_id", "event_type")
    stream = staged_stream(e.withColumn("arrived", F.col("event_id")), "arrivals", "arrived")
    stored = SG.store_unique(stream, fresh_path(spark, "stored"), fresh_path(spark, "stored-state"), arrival=("arrived",))
    return stored.select(KEY, ts_us("ts"), "event_id", "event_type")


@query("stream_upsert", "select user_id, max(event_id) as version, arg_max(event_type, event_id) as state, epoch_us(arg_max(ts, event_id)) as ts_us from events group by 1")
def stream_upsert(spark, sf):
    """States by key, of writers that come in any order."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    stream = staged_stream(e.withColumn("_o", F.hash("version")), "states", "_o").drop("_o")
    kept = SG.keep_latest(stream, ["user_id"], "version", fresh_path(spark, "upsert"), fresh_path(spark, "upsert-state"))
    return kept.select("user_id", "version", "state", ts_us("ts"))


@query("stream_revisions", with_ctes(READINGS, NWP, _HOURLY, _REVISION) + "select station_id, epoch_us(issued_hour) as issued_us, status from rev")
def stream_revisions(spark, sf):
    stream = staged_stream(_hourly(spark, sf).drop("weathercode", "lead_hours"), "issues", "issued_hour")
    return RV.watch(stream).select(KEY, F.unix_micros("issued_hour").alias("issued_us"), "status")
