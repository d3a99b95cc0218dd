"""Sources, table semantics, unit and text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import physics as P
from ..functions import units as U
from ..operators import clean as C
from ..operators import entities as EN
from ..operators import summaries as S
from ..operators.chunks import KEY
from ..operators.lineage import fresh_path
from ..sources import forecasts as SF
from ..sources import history as SH
from .fixtures import FORECASTS, NWP, READINGS, forecast_log, nwp_log, readings, table, with_ctes
from .registry import query, rd, sql_rd, ts_us
from .series import SERIES, repaired_series

# ---- table semantics -------------------------------------------------------------------


@query("reading_dedupe", with_ctes(READINGS) + """
, m as (select station_id, date_trunc('minute', ts) as minute, rn, temp, row_number() over (partition by station_id, date_trunc('minute', ts) order by rn desc) as k from readings)
select station_id, epoch_us(minute) as minute_us, rn, round(temp,4)+0.0 as temp from m where k=1""")
def reading_dedupe(spark, sf):
    r = readings(spark, sf).select(KEY, F.date_trunc("minute", "ts").alias("minute"), "rn", "temp")
    return C.latest_by_key(r, [KEY, "minute"], [F.col("rn")]).select(KEY, ts_us("minute"), "rn", rd("temp", 4).alias("temp"))


@query("history_merge", with_ctes(READINGS) + """
, u as (select station_id, date_trunc('minute', ts) as minute, rn, temp, 0 as rank from readings
  union all select station_id, date_trunc('minute', ts + interval 90 seconds), rn, temp+100, 1 from readings),
k as (select *, row_number() over (partition by station_id, minute order by rank desc, rn desc) as k from u)
select station_id, epoch_us(minute) as minute_us, rn, round(temp,4)+0.0 as temp from k where k=1""")
def history_merge(spark, sf):
    """Two sources on partly equal minutes; the second one wins."""
    r = readings(spark, sf)
    files = r.select(KEY, F.date_trunc("minute", "ts").alias("minute"), "rn", "temp")
    stored = r.select(KEY, F.date_trunc("minute", F.expr("ts + interval 90 seconds")).alias("minute"), "rn", (F.col("temp") + 100).alias("temp"))
    return C.merge_history(files, stored, key=(KEY, "minute"), order="rn").select(KEY, ts_us("minute"), "rn", rd("temp", 4).alias("temp"))


_IGNORE = """
, stored as (select station_id, date_trunc('minute', ts + interval 2 hours) as minute from readings),
b as (select *, date_trunc('minute', ts) as minute, row_number() over (partition by station_id, date_trunc('minute', ts) order by rn) as k from readings r
  where not exists (select 1 from stored s where s.station_id=r.station_id and s.minute=date_trunc('minute', r.ts)))
select station_id, epoch_us(minute) as minute_us, rn from b where k=1"""


@query("insert_ignore", with_ctes(READINGS) + _IGNORE)
def insert_ignore(spark, sf):
    r = readings(spark, sf)
    stored = r.select(KEY, F.date_trunc("minute", F.expr("ts + interval 2 hours")).alias("minute"))
    batch = r.select(KEY, F.date_trunc("minute", "ts").alias("minute"), "rn")
    return C.insert_ignore(stored, batch, [KEY, "minute"], "rn").select(KEY, ts_us("minute"), "rn")


def _scores(df, mult):
    date = F.to_date("issued_at")
    return df.groupBy(date.alias("as_of_date"), "source_layer", "lead_minutes").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("rain_prob") * mult).alias("mean_predicted"), F.max(F.unix_micros("issued_at")).alias("arrival"))


@query("score_upsert", with_ctes(READINGS, FORECASTS) + """
, o as (select issued_at::date as d, source_layer, lead_minutes, count(*) as n, avg(rain_prob) as m from forecast_log group by 1,2,3),
c as (select issued_at::date as d, source_layer, lead_minutes, count(*) as n, 2*avg(rain_prob) as m from forecast_log where lead_minutes<>5 and issued_at >= timestamp '2024-01-02' group by 1,2,3)
select cast(coalesce(c.d,o.d) as varchar) as as_of_date, coalesce(c.source_layer,o.source_layer) as source_layer, coalesce(c.lead_minutes,o.lead_minutes)::int as lead_minutes,
 case when c.n is null then o.n else c.n end as n, round(case when c.n is null then o.m else c.m end,6)+0.0 as mean_predicted
from o full join c on c.d=o.d and c.source_layer=o.source_layer and c.lead_minutes=o.lead_minutes""")
def score_upsert(spark, sf):
    f = forecast_log(spark, sf)
    old = _scores(f, 1.0)
    new = _scores(f.filter("lead_minutes <> 5 and issued_at >= timestamp'2024-01-02'"), 2.0)
    out = C.upsert(old, new, ["as_of_date", "source_layer", "lead_minutes"], "arrival")
    return out.select(F.col("as_of_date").cast("string").alias("as_of_date"), "source_layer", F.col("lead_minutes").cast("int").alias("lead_minutes"),
                      "n", rd("mean_predicted").alias("mean_predicted"))


@query("forecast_metadata", with_ctes(READINGS, FORECASTS) + """
, a as (select source_layer, lead_minutes, 'v'||lead_minutes as version, avg(rain_prob) as conf from forecast_log where lead_minutes in (5,30) group by 1,2),
b as (select source_layer, 'any' as version, max(rain_prob) as conf from forecast_log where source_layer='radar_advection' group by 1)
select f.station_id, epoch_us(f.issued_at) as issued_us, f.lead_minutes::int as lead_minutes, f.source_layer,
 case when a.source_layer is not null then a.version else b.version end as model_version,
 round(case when a.source_layer is not null then a.conf else b.conf end,6)+0.0 as data_confidence
from forecast_log f left join a on a.source_layer=f.source_layer and a.lead_minutes=f.lead_minutes left join b on b.source_layer=f.source_layer""")
def forecast_metadata(spark, sf):
    f = forecast_log(spark, sf)
    by_lead = f.filter("lead_minutes in (5, 30)").groupBy("source_layer", "lead_minutes").agg(
        F.concat(F.lit("v"), F.col("lead_minutes").cast("string")).alias("model_version"), F.avg("rain_prob").alias("data_confidence"))
    by_source = f.filter("source_layer = 'radar_advection'").groupBy("source_layer").agg(
        F.lit("any").alias("model_version"), F.max("rain_prob").alias("data_confidence"))
    out = C.with_metadata(f, by_lead, by_source, ["model_version", "data_confidence"])
    return out.select(KEY, F.unix_micros("issued_at").alias("issued_us"), F.col("lead_minutes").cast("int").alias("lead_minutes"),
                      "source_layer", "model_version", rd("data_confidence").alias("data_confidence"))


# ---- range scans -----------------------------------------------------------------------
_A, _B = "2024-01-01 06:00:00", "2024-01-02 06:00:00"


def _at(text):
    return F.expr(f"timestamp'{text}'")


@query("range_readings", with_ctes(READINGS) + f"""
select station_id, epoch_us(ts) as ts_us, round(temp,4)+0.0 as temp, rain_flag from readings where ts>=timestamp '{_A}' and ts<timestamp '{_B}' order by ts""")
def range_readings(spark, sf):
    df = C.time_range(readings(spark, sf), "ts", _at(_A), _at(_B)).orderBy("ts")
    return df.select(KEY, ts_us("ts"), rd("temp", 4).alias("temp"), "rain_flag")


@query("range_forecasts", with_ctes(READINGS, FORECASTS) + f"""
select station_id, epoch_us(issued_at) as issued_at_us, epoch_us(valid_at) as valid_at_us, source_layer, round(rain_prob,4)+0.0 as rain_prob
from forecast_log where issued_at>=timestamp '{_A}' and issued_at<timestamp '{_B}' order by valid_at""")
def range_forecasts(spark, sf):
    df = C.time_range(forecast_log(spark, sf), "issued_at", _at(_A), _at(_B)).orderBy("valid_at")
    return df.select(KEY, ts_us("issued_at"), ts_us("valid_at"), "source_layer", rd("rain_prob", 4).alias("rain_prob"))


@query("range_nwp", with_ctes(READINGS, NWP) + f"""
select station_id, epoch_us(issued_hour) as issued_hour_us, epoch_us(valid_at) as valid_at_us, lead_hours from nwp_log where valid_at>=timestamp '{_B}' order by valid_at, lead_hours""")
def range_nwp(spark, sf):
    df = C.time_range(nwp_log(spark, sf), "valid_at", start=_at(_B)).orderBy("valid_at", "lead_hours")
    return df.select(KEY, ts_us("issued_hour"), ts_us("valid_at"), "lead_hours")


@query("range_temperature", with_ctes(READINGS) + f"select station_id, epoch_us(ts) as ts_us, round(temp,4)+0.0 as temp from readings where ts<timestamp '{_A}'")
def range_temperature(spark, sf):
    return C.time_range(readings(spark, sf).select(KEY, "ts", "temp"), "ts", end=_at(_A)).select(KEY, ts_us("ts"), rd("temp", 4).alias("temp"))


@query("newest_days", with_ctes(READINGS) + """
select station_id, epoch_us(ts) as ts_us, cast(ts::date as varchar) as date from readings
where ts::date in (select distinct ts::date as d from readings order by d desc limit 2)""")
def newest_days(spark, sf):
    df = readings(spark, sf).withColumn("date", F.to_date("ts"))
    return SH.newest_days(df, 2).select(KEY, ts_us("ts"), F.col("date").cast("string").alias("date"))


# ---- text rows as a CSV reader delivers them --------------------------------------------
def _lines(spark, sf):
    """Readings as text: mixed time formats, repeated headers, bad numbers, infinities."""
    r = readings(spark, sf)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamp = (
        F.when(F.col("rn") % 13 == 0, "timestamp").when(F.col("rn") % 4 == 1, F.concat(F.translate(text, " ", "T"), F.lit("Z")))
        .when(F.col("rn") % 4 == 2, F.concat(F.date_format(F.expr("ts + interval 7 hours"), "yyyy-MM-dd HH:mm:ss"), F.lit("+07:00")))
        .otherwise(text))
    hum = F.when(F.col("rn") % 17 == 0, "n/a").when(F.col("rn") % 19 == 0, "inf").otherwise(F.col("humidity").cast("string"))
    return r.select(
        KEY, "rn", stamp.alias("timestamp"), F.col("temp").cast("string").alias("temp"), hum.alias("humidity"),
        F.col("pressure").cast("string").alias("pressure"), F.col("rain_flag").cast("string").alias("rain_flag"),
        F.when(F.col("rn") % 3 == 0, F.lit("")).otherwise(F.col("light").cast("string")).alias("light"))


@query("csv_coerce", with_ctes(READINGS) + """
select station_id, rn, epoch_us(ts) as ts_us, round(temp,4)+0.0 as temp, humidity, round(pressure,4)+0.0 as pressure, case when rn%3=0 then null else light end as light
from readings where rn%13<>0 and rn%17<>0 and rn%19<>0""")
def csv_coerce(spark, sf):
    df = C.coerce(_lines(spark, sf), [*C.CORE_COLUMNS, "light"])
    return df.select(KEY, "rn", F.unix_micros("timestamp").alias("ts_us"), rd("temp", 4).alias("temp"), "humidity", rd("pressure", 4).alias("pressure"), "light")


@query("csv_versions", with_ctes(READINGS) + """
select station_id, rn, epoch_us(ts) as ts_us, round(temp,4)+0.0 as temp, humidity, round(pressure,4)+0.0 as pressure, case when rn%5<2 or rn%3=0 then null else light end as light,
 case when rn%5=4 then round(wind_speed,6)+0.0 end as wind_speed
from readings where rn%13<>0 and rn%17<>0 and rn%19<>0""")
def csv_versions(spark, sf):
    """A folder of files in three versions of the header, written and then read without naming them."""
    folder = fresh_path(spark, "csv-versions")
    lines = _lines(spark, sf).join(readings(spark, sf).select(KEY, "rn", F.col("wind_speed").cast("string").alias("wind_speed")), [KEY, "rn"])
    core = ["timestamp", "temp", "humidity", "pressure", "rain_flag"]
    versions = {"rn % 5 < 2": [KEY, "rn", *core], "rn % 5 in (2, 3)": [*core, "light", KEY, "rn"], "rn % 5 = 4": ["rn", KEY, "wind_speed", *core, "light"]}
    for which, columns in versions.items():
        lines.filter(which).select(*columns).write.mode("append").option("header", True).csv(folder)
    df = SH.scan_folder(spark, folder, key=[KEY, "rn"])
    return df.select(
        F.col(KEY).cast("long").alias(KEY), F.col("rn").cast("long").alias("rn"), F.unix_micros("timestamp").alias("ts_us"), rd("temp", 4).alias("temp"), "humidity",
        rd("pressure", 4).alias("pressure"), "light", rd("wind_speed").alias("wind_speed"))


@query("sink_round_trip", with_ctes(READINGS) + """
select station_id, epoch_us(ts) as ts_us, round(case when ts::date = date '2024-01-02' then temp + 1 else temp end, 6)+0.0 as temp, cast(ts::date as varchar) as date from readings""")
def sink_round_trip(spark, sf):
    """Readings appended by date, one date then replaced, and all read back."""
    path = fresh_path(spark, "by-date")
    r = readings(spark, sf).select(KEY, "ts", "temp")
    SH.append_by_date(r, path)
    SH.replace_dates(r.filter("to_date(ts) = date'2024-01-02'").withColumn("temp", F.col("temp") + 1), path)
    return spark.read.parquet(path).select(KEY, ts_us("ts"), rd("temp").alias("temp"), F.col("date").cast("string").alias("date"))


@query("report_round_trip", with_ctes(READINGS) + "select station_id, date_part('hour', ts)::int as hour, count(*) as n, round(avg(temp),5)+0.0 as temp_avg from readings group by all")
def report_round_trip(spark, sf):
    """A report written as CSV by station and read back."""
    path = fresh_path(spark, "report")
    report = readings(spark, sf).groupBy(KEY, F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), rd(F.avg("temp"), 5).alias("temp_avg"))
    SH.write_report(report, path, by=(KEY,), fmt="csv")
    return spark.read.option("header", True).schema("hour int, n long, temp_avg double").csv([f"{path}/{KEY}=*"]).withColumn(
        KEY, F.regexp_extract(F.input_file_name(), rf"{KEY}=(\d+)", 1).cast("long"))


@query("csv_backfill", with_ctes(READINGS) + """
, c as (select *, row_number() over (partition by station_id, ts order by rn) as k from readings where rn%13<>0 and rn%17<>0 and rn%19<>0
   and not exists (select 1 from readings s where s.station_id=readings.station_id and s.ts + interval 21 minutes = readings.ts))
select station_id, epoch_us(ts) as ts_us, rn from c where k=1""")
def csv_backfill(spark, sf):
    incoming = C.coerce(_lines(spark, sf), C.CORE_COLUMNS).withColumnRenamed("timestamp", "ts").select(KEY, "ts", "rn")
    stored = readings(spark, sf).select(KEY, F.expr("ts + interval 21 minutes").alias("ts"))
    return SH.backfill(stored, incoming, [KEY, "ts"], "rn").select(KEY, ts_us("ts"), "rn")


# ---- forecast documents ------------------------------------------------------------------
# One document per (station, issue hour): 48 hourly values starting two hours before the current hour, and nine days.
_CODES = "array(0, 3, 61, 95, 42)"


def _documents(spark, sf):
    h = nwp_log(spark, sf).filter("lead_hours = 0").select(KEY, "issued_hour")
    hours = F.sequence(F.lit(0), F.lit(47))
    days = F.sequence(F.lit(0), F.lit(8))
    start = F.expr("issued_hour + interval 5 hours")  # local clock, two hours back

    def val(expr):
        return F.transform(hours, expr)

    hourly = F.struct(
        val(lambda i: F.date_format(F.timestamp_micros(F.unix_micros(start) + i.cast("long") * 3_600_000_000), "yyyy-MM-dd'T'HH:mm")).alias("time"),
        val(lambda i: F.when(i % 11 != 5, 20.0 + (i * 3 + F.hour("issued_hour")) % 17)).alias("temperature_2m"),
        val(lambda i: ((i * 7 + F.hour("issued_hour")) % 101).cast("double")).alias("precipitation_probability"),
        val(lambda i: (i % 4) / 2.0).alias("precipitation"), val(lambda i: (i * 5 % 36).cast("double")).alias("wind_speed_10m"),
        val(lambda i: (i * 10 % 360).cast("double")).alias("wind_direction_10m"), val(lambda i: (i * 9 % 101).cast("double")).alias("cloud_cover"),
        val(lambda i: F.element_at(F.expr(_CODES), i % 5 + 1)).alias("weathercode"))
    daily = F.struct(
        F.transform(days, lambda i: F.date_format(F.timestamp_micros(F.unix_micros("issued_hour") + i.cast("long") * 86_400_000_000), "yyyy-MM-dd")).alias("time"),
        F.transform(days, lambda i: 20.0 + i).alias("temperature_2m_min"), F.transform(days, lambda i: 30.0 + i).alias("temperature_2m_max"),
        F.transform(days, lambda i: (i * 12 + F.col(KEY)).cast("double")).alias("precipitation_probability_max"),
        F.transform(days, lambda i: F.element_at(F.expr(_CODES), i % 5 + 1)).alias("weather_code"))
    current = F.struct(F.date_format(F.expr("issued_hour + interval 7 hours 15 minutes"), "yyyy-MM-dd'T'HH:mm").alias("time"))
    return h.select(KEY, "issued_hour", F.to_json(F.struct(current.alias("current"), hourly.alias("hourly"), daily.alias("daily"))).alias("document"))


_WORDS = ", ".join(f"({k}, '{v}')" for k, v in U.WEATHER_WORDS.items())
_DOCS = f"""
words(code, word) as (values {_WORDS}),
dh as (select station_id, issued_hour, i, issued_hour + interval 5 hours + to_hours(i) as hr, i-2 as lead,
   case when i%11<>5 then 20.0+(i*3+hour(issued_hour))%17 end::double as temp, ((i*7+hour(issued_hour))%101)::double as rain_prob, (i%4)/2.0::double as precip,
   (i*5%36)::double as wind, (i*10%360)::double as dir, (i*9%101)::double as cloud, ([0,3,61,95,42])[i%5+1] as code
  from nwp_log cross join (select unnest(range(0,48))::int as i) where lead_hours=0),
dd as (select station_id, issued_hour, i as day_index, (issued_hour + to_days(i))::date as date, 20.0::double+i as temp_min, 30.0::double+i as temp_max, (i*12+station_id)::double as rain_prob_max,
   ([0,3,61,95,42])[i%5+1] as code from nwp_log cross join (select unnest(range(0,9))::int as i) where lead_hours=0)
"""


@query("nwp_hourly_flatten", with_ctes(READINGS, NWP, _DOCS) + """
select station_id, strftime(issued_hour + interval 7 hours, '%Y-%m-%dT%H:00') as issued_hour, strftime(hr, '%Y-%m-%dT%H:%M') as time, lead as lead_hours,
  temp, rain_prob, precip as precip_mm, wind as wind_kmh, coalesce(word, 'code '||dh.code) as condition
from dh left join words on words.code=dh.code where lead between 0 and 23""")
def nwp_hourly_flatten(spark, sf):
    df = SF.hourly_timeline(_documents(spark, sf).drop("issued_hour"), [KEY])
    return df.select(KEY, "issued_hour", "time", "lead_hours", "temp", "rain_prob", "precip_mm", "wind_kmh", "condition")


@query("nwp_daily_flatten", with_ctes(READINGS, NWP, _DOCS) + """
select station_id, epoch_us(issued_hour) as issued_us, day_index, cast(date as varchar) as date, temp_min, temp_max, rain_prob_max, coalesce(word, 'code '||dd.code) as condition
from dd left join words on words.code=dd.code where day_index<7""")
def nwp_daily_flatten(spark, sf):
    df = SF.daily_forecast(_documents(spark, sf), [KEY, "issued_hour"])
    return df.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), "day_index", "date", "temp_min", "temp_max", "rain_prob_max", "condition")


@query("nwp_log_rows", with_ctes(READINGS, NWP, _DOCS) + """
select station_id, epoch_us(issued_hour) as issued_us, epoch_us(hr - interval 7 hours) as valid_us, lead as lead_hours, temp as temp_forecast,
 rain_prob as precipitation_probability, round(wind/3.6,6)+0.0 as wind_speed, dir as wind_direction from dh where lead between 0 and 23 and temp is not null""")
def nwp_log_rows(spark, sf):
    df = SF.nwp_log_rows(SF.hourly_timeline(_documents(spark, sf).drop("issued_hour"), [KEY]))
    return df.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), F.unix_micros("valid_at").alias("valid_us"), "lead_hours",
                     "temp_forecast", "precipitation_probability", rd("wind_speed").alias("wind_speed"), "wind_direction")


@query("forecast_log_rows", with_ctes(READINGS) + """
select station_id, epoch_us(ts) as issued_us, epoch_us(ts)+lead*60000000 as valid_us, lead::int as lead_minutes, round(p,6)+0.0 as rain_prob, source_layer from (
 select station_id, ts, lead, ((rn*lead)%101)/101.0::double as p, 'local_rf' as source_layer from readings cross join (values (5),(10),(30)) l(lead)
 union all select station_id, ts, 5*(rn%25), (rn%100)/100.0::double, 'radar_advection' from readings where rn%3=0)""")
def forecast_log_rows(spark, sf):
    probs = F.create_map(*[x for h in (5, 10, 30) for x in (F.lit(f"{h}m"), (F.col("rn") * h) % 101 / 101.0)])
    arrival = F.when(F.col("rn") % 7 != 0, F.struct((F.col("rn") % 3 == 0).alias("rain_arriving"), (5 * (F.col("rn") % 25)).alias("eta_minutes"), (F.col("rn") % 100 / 100.0).alias("confidence")))
    always = F.struct((F.col("rn") % 3 == 0).alias("rain_arriving"), (5 * (F.col("rn") % 25)).alias("eta_minutes"), (F.col("rn") % 100 / 100.0).alias("confidence"))
    p = readings(spark, sf).select(KEY, F.col("ts").alias("issued_at"), F.lit("rf").alias("model"), probs.alias("probabilities"), F.coalesce(arrival, always).alias("arrival"))
    out = SF.forecast_log_rows(p)
    return out.select(KEY, F.unix_micros("issued_at").alias("issued_us"), F.unix_micros("valid_at").alias("valid_us"), "lead_minutes", rd("rain_prob").alias("rain_prob"), "source_layer")


# ---- scalar functions --------------------------------------------------------------------
# Raw states of entities, many per poll.
STATES = """
states as (select cast(user_id%4 as bigint) as station_id, event_id, time_bucket(interval '6 hours', ts) as poll_at,
  case event_type when 'click' then 'temp' when 'view' then 'humidity' when 'purchase' then 'pressure' when 'error' then 'rain' else 'wind_speed' end as entity,
  case when event_id%17=0 then 'unavailable' when event_type='error' then case when event_id%2=0 then 'on' else 'off' end
   when event_type='purchase' then cast(round(case event_id%4 when 0 then 101000+value when 1 then 101.0+value/1000 when 2 then 29.9+value/1000 else 1000+value/10 end,3) as varchar)
   else cast(value as varchar) end as state,
  case event_type when 'click' then (['°C','°F','K','bogus'])[1+event_id%4] when 'view' then (['%','percent','ratio','%'])[1+event_id%4]
   when 'purchase' then (['Pa','kPa','inHg','hPa'])[1+event_id%4] when 'signup' then (['m/s','km/h','mph','kn'])[1+event_id%4] end as unit,
  ts as last_reported from events)
"""
_NORM = """
nums as (select *, try_cast(state as double) as v from states),
norm as (select *, case entity
  when 'temp' then case unit when '°C' then v when '°F' then (v-32)*5/9 when 'K' then v-273.15 end
  when 'humidity' then case when unit='ratio' and v between 0 and 1 then v*100 else v end
  when 'pressure' then case unit when 'Pa' then v/100 when 'kPa' then v*10 when 'inHg' then v*33.8638866667 else v end
  when 'wind_speed' then case unit when 'm/s' then v when 'km/h' then v/3.6 when 'mph' then v*0.44704 else v*0.5144444444 end end as x from nums),
val as (select *, case entity when 'temp' then case when x between -100 and 80 then x end when 'humidity' then case when x between 0 and 100 then x end
  when 'pressure' then case when x between 700 and 1100 then x end when 'wind_speed' then case when x between 0 and 100 then x end
  when 'rain' then case state when 'on' then 1.0 when 'off' then 0.0 end end as value from norm)
"""


def states(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    entity = (F.when(F.col("event_type") == "click", "temp").when(F.col("event_type") == "view", "humidity")
              .when(F.col("event_type") == "purchase", "pressure").when(F.col("event_type") == "error", "rain").otherwise("wind_speed"))
    v = F.col("value")
    pressure = F.when(k == 0, 101000 + v).when(k == 1, 101.0 + v / 1000).when(k == 2, 29.9 + v / 1000).otherwise(1000 + v / 10)
    state = (F.when(F.col("event_id") % 17 == 0, "unavailable")
             .when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "on").otherwise("off"))
             .when(F.col("event_type") == "purchase", rd(pressure, 3).cast("string")).otherwise(v.cast("string")))

    def pick(*names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))

    unit = (F.when(F.col("event_type") == "click", pick("°C", "°F", "K", "bogus")).when(F.col("event_type") == "view", pick("%", "percent", "ratio", "%"))
            .when(F.col("event_type") == "purchase", pick("Pa", "kPa", "inHg", "hPa")).when(F.col("event_type") == "signup", pick("m/s", "km/h", "mph", "kn")))
    six = 6 * 3600 * 1_000_000
    poll = F.timestamp_micros((F.floor(F.unix_micros("ts") / float(six)) * six).cast("long"))
    return e.select((F.col("user_id") % 4).cast("long").alias(KEY), "event_id", poll.alias("poll_at"), entity.alias("entity"),
                    state.alias("state"), unit.alias("unit"), F.col("ts").alias("last_reported"))


@query("unit_normalise", with_ctes(STATES, _NORM) + "select event_id, entity, round(value,4)+0.0 as value from val")
def unit_normalise(spark, sf):
    s = states(spark, sf)
    st, un = F.col("state"), F.col("unit")
    value = (F.when(F.col("entity") == "temp", U.celsius(st, un)).when(F.col("entity") == "humidity", U.humidity_percent(st, un))
             .when(F.col("entity") == "pressure", U.hectopascal(st, un)).when(F.col("entity") == "rain", U.rain_amount(st)).otherwise(U.metres_per_second(st, un)))
    return s.select("event_id", "entity", rd(value, 4).alias("value"))


_LATEST = """
ranked as (select *, row_number() over (partition by station_id, poll_at, entity order by last_reported desc) as k from val),
piv as (select station_id, poll_at, max(case when entity='temp' then last_reported end) as t_at, max(case when entity='temp' then value end) as t,
  max(case when entity='humidity' then last_reported end) as h_at, max(case when entity='humidity' then value end) as h,
  max(case when entity='pressure' then last_reported end) as p_at, max(case when entity='pressure' then value end) as p,
  max(case when entity='rain' then last_reported end) as r_at, max(case when entity='rain' then value end) as r, max(case when entity='rain' then state end) as r_state,
  max(case when entity='wind_speed' then last_reported end) as w_at, max(case when entity='wind_speed' then value end) as w from ranked where k=1 group by 1,2),
aged as (select *, poll_at + interval 6 hours as now_ts from piv),
why as (select *, case
  when t_at is null then 'missing_timestamp_temp' when now_ts-t_at>interval 2 hours then 'stale_temp'
  when h_at is null then 'missing_timestamp_humidity' when now_ts-h_at>interval 4 hours then 'stale_humidity'
  when p_at is null then 'missing_timestamp_pressure' when now_ts-p_at>interval 2 hours then 'stale_pressure'
  when r_at is not null and r is null and now_ts-r_at>interval 2 hours then 'stale_rain'
  when t is null then 'invalid_temp' when h is null then 'invalid_humidity' when p is null then 'invalid_pressure'
  when r_at is not null and r is null then 'invalid_rain' end as reason from aged),
asm as (select *, reason is null as ok from why)
"""
_ASM_SQL = """select station_id, epoch_us(poll_at) as poll_us, case when ok then 'ready' when reason like 'stale%' then 'stale' else 'unavailable' end as status, reason,
 case when ok then epoch_us(least(t_at,h_at,p_at, case when now_ts-r_at<=interval 2 hours then r_at end)) end as ts_us,
 case when ok then round(t,4)+0.0 end as temp, case when ok then round(h,4)+0.0 end as humidity, case when ok then round(p,4)+0.0 end as pressure,
 case when ok then coalesce(r,0.0)::double end as rain_flag, case when ok and now_ts-w_at<=interval 2 hours then round(w,4)+0.0 end as wind_speed from asm"""


def _assembled(spark, sf):
    now = F.expr("poll_at + interval 6 hours")
    return EN.assemble(states(spark, sf), now, EN.Freshness(default=7200.0, humidity=14400.0))


@query("entity_assembly", with_ctes(STATES, _NORM, _LATEST) + _ASM_SQL)
def entity_assembly(spark, sf):
    return _assembled(spark, sf).select(
        KEY, F.unix_micros("poll_at").alias("poll_us"), "status", "reason", ts_us("ts"),
        *[rd(c, 4).alias(c) for c in ("temp", "humidity", "pressure")], "rain_flag", rd("wind_speed", 4).alias("wind_speed"))


@query("duplicate_suppression", with_ctes(READINGS) + """
, d as (select station_id, ts, rn, rain_flag, cast(floor(temp/4) as bigint) as t4 from readings),
l as (select *, lag(rain_flag) over (partition by station_id order by ts) as pr, lag(t4) over (partition by station_id order by ts) as pt, row_number() over (partition by station_id order by ts) as i from d)
select station_id, epoch_us(ts) as ts_us, rn from l where i=1 or pr<>rain_flag or pt<>t4""")
def duplicate_suppression(spark, sf):
    r = readings(spark, sf).select(KEY, "ts", "rn", "rain_flag", F.floor(F.col("temp") / 4).alias("t4"))
    return EN.drop_repeats(r, "ts", EN.fingerprint("rain_flag", "t4", doubles=("rain_flag",))).select(KEY, ts_us("ts"), "rn")


_HI = ("-8.78469475556+1.61139411*temp+2.33854883889*humidity-0.14611605*temp*humidity-0.012308094*temp*temp-0.0164248277778*humidity*humidity"
       "+0.002211732*temp*temp*humidity+0.00072546*temp*humidity*humidity-0.000003582*temp*temp*humidity*humidity")
HEAT_SQL = f"case when temp>=27 and humidity>=40 then {_HI} else temp end"
COMFORT_SQL = "case when {x}<27 then 'comfortable' when {x}<32 then 'caution' when {x}<41 then 'extreme_caution' when {x}<54 then 'danger' else 'extreme_danger' end"


@query("comfort", with_ctes(READINGS) + f"""
, h as (select *, {HEAT_SQL} as hi, temp-(100-humidity)/5 as dp, pressure - lag(pressure,10,pressure) over (partition by station_id order by ts) as tr from readings)
select station_id, epoch_us(ts) as ts_us, round(hi,6)+0.0 as heat_index, {COMFORT_SQL.format(x='hi')} as comfort, round(dp,6)+0.0 as dew_point, round(temp-dp,6)+0.0 as gap,
 case when pressure>1005.5 then 'ขึ้น ↑' when pressure<1004.5 then 'ลง ↓' else 'คงที่ →' end as trend from h""")
def comfort(spark, sf):
    t, h = F.col("temp"), F.col("humidity")
    hi, dp = P.heat_index(t, h), P.dew_point(t, h)
    return readings(spark, sf).select(
        KEY, ts_us("ts"), rd(hi).alias("heat_index"), P.comfort_class(hi).alias("comfort"), rd(dp).alias("dew_point"), rd(t - dp).alias("gap"),
        P.trend_word(F.col("pressure") - 1005.0).alias("trend"))


@query("text_values", """
select event_id, case when w='x' then null when event_id%3=0 then (22.5*(event_id%16))::double else (event_id%361)::double end as degrees,
 case event_id%6 when 0 then 1.0 when 1 then 0.0 when 2 then 1.0 when 3 then 0.0 when 4 then 1.0 end::double as truth,
 case event_id%5 when 0 then null when 1 then null when 2 then 'dim' else cast(event_id%7 as varchar)||'.0' end as light,
 case when event_id%4=0 then case when cc>=90 then 'pouring' else 'rainy' end when cc is null then case when day then 'sunny' else 'clear-night' end
  when cc>=85 then 'cloudy' when cc>=30 then 'partlycloudy' else case when day then 'sunny' else 'clear-night' end end as sky,
 coalesce(cc>=70, false) as overcast
from (select *, case when event_id%11=0 then 'x' else '' end as w, case when event_id%9=0 then null else (event_id*7)%101 end as cc, event_id%2=0 as day from events)""")
def text_values(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    i = F.col("event_id")
    compass = F.element_at(F.array(*[F.lit(p.upper()) for p in U.COMPASS]), (i % 16 + 1).cast("int"))
    dir_state = F.when(i % 11 == 0, "nowhere").when(i % 3 == 0, compass).otherwise((i % 361).cast("string"))
    truth = F.element_at(F.array(*[F.lit(x) for x in ("true", "FALSE", " yes", "no", "1", "maybe")]), (i % 6 + 1).cast("int"))
    light = F.when(i % 5 == 0, "unknown").when(i % 5 == 1, F.lit(" ")).when(i % 5 == 2, "dim").otherwise((i % 7).cast("string"))
    cloud = F.when(i % 9 != 0, (i * 7) % 101)
    return e.select(
        "event_id", U.wind_degrees(dir_state).alias("degrees"), U.truth_value(truth).alias("truth"), U.light_text(light).alias("light"),
        U.sky_condition(i % 4 == 0, cloud, i % 2 == 0).alias("sky"), U.overcast(cloud).alias("overcast"))


@query("observed_age", """
select event_id, epoch_us(coalesce(case when event_id%3=0 then ts end, case when event_id%3=1 then ts - interval 1 hour end, ts - interval 2 hours)) as at_us,
 round(greatest(0, (epoch_us(timestamp '2024-01-16 00:00:00')-epoch_us(coalesce(case when event_id%3=0 then ts end, case when event_id%3=1 then ts - interval 1 hour end, ts - interval 2 hours)))/1e6),3)+0.0 as age
from events""")
def observed_age(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    i = F.col("event_id") % 3
    at = U.observed_at(F.when(i == 0, F.col("ts")), F.when(i == 1, F.expr("ts - interval 1 hour")), F.expr("ts - interval 2 hours"))
    return e.select("event_id", F.unix_micros(at).alias("at_us"), rd(U.age_seconds(F.expr("timestamp'2024-01-16 00:00:00'"), at), 3).alias("age"))


@query("confidence", with_ctes(*SERIES) + """
, nw as (select station_id, max(segment_id) as sid, max(ts) as newest from rseg group by 1),
tl as (select r.station_id, newest, r.observation_gap_filled as f, row_number() over (partition by r.station_id order by r.ts desc) as k from rseg r join nw on nw.station_id=r.station_id and nw.sid=r.segment_id),
ag as (select station_id, any_value(newest) as newest, count(*) as n, sum(f)::int as rep from tl where k<=120 group by 1),
cf as (select *, least(1.0, n/120.0::double) as cov, greatest(0.75, 1-rep/120.0::double) as gf, 45+station_id*60 as age from ag),
sc as (select *, greatest(0.0,least(1.0,cov*greatest(0.0,1-age/180.0::double)*gf)) as s from cf)
select station_id, n, rep as repaired, round(cov,6)+0.0 as coverage, round(s,6)+0.0 as confidence, case when s>=0.85 then 'high' when s>=0.55 then 'medium' else 'low' end as level,
 case when rep>0 then 'short sensor gap repaired' when cov<1 then 'short or interrupted sensor context' else 'latest sensor observation is aging' end as reason from sc""")
def confidence(spark, sf):
    """Judged 45, 105, 165 and 225 s after each station's newest row."""
    df = repaired_series(spark, sf)
    newest = F.timestamp_micros(F.unix_micros("newest_ts") + 45_000_000 + F.col(KEY) * 60_000_000)
    out = S.confidence(df, newest)
    return out.select(KEY, F.round(F.col("feature_coverage") * 120).cast("long").alias("n"), "repaired", rd("feature_coverage").alias("coverage"),
                      rd("data_confidence").alias("confidence"), F.col("confidence_level").alias("level"), F.col("confidence_reason").alias("reason"))


@query("tile_geometry", """
select c_custkey as id, cast(floor(x) as int) as tile_x, cast(floor(y) as int) as tile_y, cast(floor((x-floor(x))*256) as int) as pixel_x, cast(floor((y-floor(y))*256) as int) as pixel_y,
 round(156543.03392*cos(radians(lat))/128,4)+0.0 as meters from (
 select c_custkey, lat, (lon+180)/360*128 as x, (1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*128 as y from (
  select c_custkey, 13+(c_custkey%200)/100.0::double as lat, 100+((c_custkey*7)%200)/100.0::double as lon from customer))""")
def tile_geometry(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (13 + F.col("c_custkey") % 200 / 100.0).alias("lat"), (100 + F.col("c_custkey") * 7 % 200 / 100.0).alias("lon"))
    pos = G.tile_position(F.col("lat"), F.col("lon"))
    return c.select("id", *[col.alias(n) for n, col in pos.items()], rd(G.meters_per_pixel(F.col("lat")), 4).alias("meters"))


@query("bearing", """
select p_partkey as id, cast(round_even(((degrees(atan2(dx,-dy)))%360+360)%360, 0) as int) as bearing from (select p_partkey, (p_partkey%61)-30.0::double as dx, ((p_partkey*7)%61)-30.5::double as dy from part)""")
def bearing(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 61 - 30.0).alias("dx"), (F.col("p_partkey") * 7 % 61 - 30.5).alias("dy"))
    return p.select("id", G.bearing(F.col("dx"), F.col("dy")).alias("bearing"))


@query("intensity_class", """
select p_partkey as id, case when a<32 then 0 when r>=200 and b<=20 then 4 when b-r>=60 then case when b>=202 then 1 when b>=149 then 2 else 3 end else 0 end as bucket
from (select p_partkey, (p_partkey*37)%256 as r, (p_partkey*91)%256 as b, (p_partkey*53)%256 as a from part)""")
def intensity_class(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), G.intensity_class(k * 37 % 256, k * 91 % 256, k * 53 % 256).alias("bucket"))
