"""Summaries, revisions, warnings, radar and the blended forecast."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import meters_per_pixel
from ..operators import areas as W
from ..operators import blend as B
from ..operators import daily as DS
from ..operators import entities as EN
from ..operators import radar as R
from ..operators import rain_events as RE
from ..operators import revision as V
from ..operators import summaries as S
from ..operators.chunks import KEY
from ..operators.lineage import fresh_path
from ..policy import GridPolicy
from .cleaning import COMFORT_SQL, HEAT_SQL
from .fixtures import FORECASTS, NWP, READINGS, forecast_log, nwp_log, readings, table, with_ctes
from .happenings import _GATE, _cut_history, _recursive
from .registry import QUERIES, query, rd, sql_rd, ts_us

_SUMMARY = f"""count(*) as count, min(temp) as temp_min, max(temp) as temp_max, avg(temp) as temp_avg, min(humidity) as humidity_min, max(humidity) as humidity_max,
 avg(humidity) as humidity_avg, min(pressure) as pressure_min, max(pressure) as pressure_max, count(*) filter (where rain_flag>0)::double as rain_minutes, max(hi) as hmax, avg(hi) as havg"""
_SUMMARY_OUT = (", ".join(sql_rd(c, c, 5) for c in ("temp_min", "temp_max", "temp_avg", "humidity_min", "humidity_max", "humidity_avg", "pressure_min", "pressure_max"))
                + f", count, rain_minutes, round(hmax,5)+0.0 as heat_index_max, round(havg,5)+0.0 as heat_index_avg, {COMFORT_SQL.format(x='hmax')} as comfort_level_peak")
_SUMMARY_COLS = ("temp_min", "temp_max", "temp_avg", "humidity_min", "humidity_max", "humidity_avg", "pressure_min", "pressure_max", "heat_index_max", "heat_index_avg")


def _summary_out(df, *keys):
    return df.select(*keys, "count", "rain_minutes", "comfort_level_peak", *[rd(c, 5).alias(c) for c in _SUMMARY_COLS])


@query("daily_summary", with_ctes(READINGS) + f"""
, h as (select *, {HEAT_SQL} as hi, (ts + interval 7 hours)::date as d from readings), g as (select station_id, d, {_SUMMARY} from h group by 1,2)
select station_id, cast(d as varchar) as date, {_SUMMARY_OUT} from g""")
def daily_summary(spark, sf):
    return _summary_out(S.daily_summary(readings(spark, sf)), KEY, F.col("date").cast("string").alias("date"))


@query("weekly_summary", with_ctes(READINGS) + f"""
, h as (select *, {HEAT_SQL} as hi from readings where ts >= timestamp '2024-01-08 12:00:00' - interval 7 days and ts < timestamp '2024-01-08 12:00:00'),
g as (select station_id, {_SUMMARY} from h group by 1) select station_id, {_SUMMARY_OUT} from g""")
def weekly_summary(spark, sf):
    return _summary_out(S.trailing_summary(readings(spark, sf), F.expr("timestamp'2024-01-08 12:00:00'")), KEY)


@query("daywise_summary", with_ctes(READINGS) + f"""
, h as (select *, {HEAT_SQL} as hi from readings where (ts + interval 7 hours)::date between date '2024-01-02' and date '2024-01-08'),
g as (select station_id, {_SUMMARY} from h group by 1) select station_id, {_SUMMARY_OUT} from g""")
def daywise_summary(spark, sf):
    """A week from stored states of its days."""
    folder = fresh_path(spark, "summary-states")
    rows = readings(spark, sf).withColumn("_d", DS.day_of("ts", 7))
    for part in (F.col("_d") < F.lit("2024-01-06").cast("date"), F.col("_d") >= F.lit("2024-01-06").cast("date")):
        DS.add_days(rows.filter(part), folder, F.col("_d"), lambda df, by: S.summary_state(df, [*by, KEY]))
    week = DS.states(spark, folder, "2024-01-02", "2024-01-09")
    return _summary_out(S.summary_of_states(week, [KEY]), KEY)


def _hourly(spark, sf):
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 3, 61, 95, 42)]), (F.pmod(F.hour("valid_at") + F.col(KEY), F.lit(5)) + 1).cast("int"))
    return nwp_log(spark, sf).select(
        KEY, "issued_hour", "valid_at", "lead_hours", F.col("temp_forecast").alias("temp"),
        F.col("precipitation_probability").alias("rain_prob"), code.alias("weathercode"))


_HOURLY = """
hourly as (select station_id, issued_hour, valid_at, lead_hours, temp_forecast as temp, precipitation_probability as rain_prob,
  ([0,3,61,95,42])[(hour(valid_at)+station_id)%5+1] as weathercode from nwp_log)
"""


@query("day_night", with_ctes(READINGS, NWP, _HOURLY) + """
, words(code, word) as (values (0,'ท้องฟ้าแจ่มใส'),(3,'มีเมฆมาก'),(61,'ฝนตกเล็กน้อย'),(95,'พายุฝนฟ้าคะนอง')),
d as (select *, valid_at + interval 7 hours as w, (min(valid_at + interval 7 hours) over (partition by station_id, issued_hour))::date as day from hourly),
p as (select *, case when w >= day + interval 6 hours and w < day + interval 18 hours then 'today' when w >= day + interval 18 hours and w < day + interval 30 hours then 'tonight' end as period from d),
k as (select *, row_number() over (partition by station_id, issued_hour, period order by rain_prob desc, w) as r from p where period is not null)
select station_id, epoch_us(issued_hour) as issued_us, period, min(temp) as temp_min, max(temp) as temp_max, max(rain_prob) as rain_prob_max,
 max(case when r=1 then coalesce(word, 'code '||weathercode) end) as condition from k left join words on words.code=k.weathercode group by 1,2,3""")
def day_night(spark, sf):
    out = S.day_night(_hourly(spark, sf), [KEY, "issued_hour"])
    return out.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), "period", "temp_min", "temp_max", "rain_prob_max", "condition")


@query("pressure_baseline", with_ctes(READINGS) + """
, w as (select *, ts + interval 7 hours as l from readings where ts >= timestamp '2024-01-04 00:30:00' - interval 8 days and ts < timestamp '2024-01-04 00:30:00'),
d as (select station_id, l::date as d, avg(pressure) as m from w where hour(l)=6 and l::date <> date '2024-01-04' group by 1,2),
k as (select *, row_number() over (partition by station_id order by d desc) as r from d),
b as (select station_id, count(*) as days, avg(m) as base from k where r<=7 group by 1 having count(*)>=2),
c as (select station_id, arg_max(pressure, ts) as cur from w group by 1)
select b.station_id, days, round(base,5)+0.0 as baseline, round(cur-base,5)+0.0 as anomaly, case when cur-base < -0.5 then 'below' when cur-base > 0.5 then 'above' else 'near' end as direction
from b join c on c.station_id=b.station_id""")
def pressure_baseline(spark, sf):
    out = S.pressure_baseline(readings(spark, sf), F.expr("timestamp'2024-01-04 00:30:00'"), min_days=2)
    return out.select(KEY, "days", rd("baseline", 5).alias("baseline"), rd("anomaly", 5).alias("anomaly"), "direction")


@query("wet_windows", with_ctes(READINGS, NWP, _HOURLY) + """
, i as (select *, sum((rain_prob<50)::int) over (partition by station_id, issued_hour order by valid_at) as isl from hourly)
select station_id, epoch_us(issued_hour) as issued_us, epoch_us(min(valid_at)) as start_us, epoch_us(max(valid_at)) as end_us, count(*) as hours
from i where rain_prob>=50 group by station_id, issued_hour, isl""")
def wet_windows(spark, sf):
    out = S.wet_windows(_hourly(spark, sf), [KEY, "issued_hour"])
    return out.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), F.unix_micros("window_start").alias("start_us"),
                      F.unix_micros("window_end").alias("end_us"), "hours")


@query("first_wet_hour", with_ctes(READINGS, NWP, _HOURLY) + """
select station_id, epoch_us(issued_hour) as issued_us, epoch_us(min(valid_at) filter (where rain_prob>=50)) as first_us from hourly group by 1,2""")
def first_wet_hour(spark, sf):
    out = S.first_wet_hour(_hourly(spark, sf), [KEY, "issued_hour"])
    return out.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), F.unix_micros("first_wet").alias("first_us"))


@query("timeline_head", with_ctes(READINGS, NWP, _HOURLY) + """
select station_id, epoch_us(issued_hour) as issued_us, epoch_us(valid_at) as valid_us from (
 select *, row_number() over (partition by station_id, issued_hour order by valid_at) as k from hourly) where k<=6""")
def timeline_head(spark, sf):
    out = S.first_rows(_hourly(spark, sf), [KEY, "issued_hour"], "valid_at", 6)
    return out.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), F.unix_micros("valid_at").alias("valid_us"))


@query("missed_slots", with_ctes(READINGS) + """
, r as (select station_id, temp, (ts + interval 7 hours) as l from readings), n as (select max(l) as l from r),
d as (select distinct station_id, l::date as date from r), s as (select distinct station_id, l::date as date, hour(l) as slot_hour from r where temp>=34.5)
select d.station_id, cast(d.date as varchar) as date, h.slot_hour from d cross join (values (6),(21)) h(slot_hour) cross join n
where (d.date < n.l::date or (d.date = n.l::date and hour(n.l) >= h.slot_hour)) and not exists
 (select 1 from s where s.station_id=d.station_id and s.date=d.date and s.slot_hour=h.slot_hour)""")
def missed_slots(spark, sf):
    r = readings(spark, sf)
    wall = S.local("ts")
    days = r.select(KEY, F.to_date(wall).alias("date")).distinct()
    sent = r.filter("temp >= 34.5").select(KEY, F.to_date(wall).alias("date"), F.hour(wall).alias("slot_hour")).distinct()
    out = S.missed_slots(days, sent, r.agg(F.max("ts")).scalar())
    return out.select(KEY, F.col("date").cast("string").alias("date"), "slot_hour")


_REVISION = """
iss as (select station_id, issued_hour, lag(issued_hour) over (partition by station_id order by issued_hour) as prev from (select distinct station_id, issued_hour from hourly)),
fw as (select station_id, issued_hour, min(valid_at) filter (where rain_prob>=50) as fw from hourly group by 1,2),
dl as (select i.station_id, i.issued_hour, count(*) as n, max(abs(a.rain_prob-b.rain_prob)) as dp, max(abs(a.temp-b.temp)) as dt from iss i
  join hourly a on a.station_id=i.station_id and a.issued_hour=i.issued_hour join hourly b on b.station_id=i.station_id and b.issued_hour=i.prev and b.valid_at=a.valid_at group by 1,2),
rv as (select i.*, n, dp, dt, (epoch_us(f.fw)-epoch_us(g.fw))/60e6 as shift from iss i left join dl on dl.station_id=i.station_id and dl.issued_hour=i.issued_hour
  left join fw f on f.station_id=i.station_id and f.issued_hour=i.issued_hour left join fw g on g.station_id=i.station_id and g.issued_hour=i.prev),
rr as (select *, array_to_string(list_filter([case when dp>=20 then 'rain_probability' end, case when abs(shift)>=60 then 'rain_window_shift' end, case when dt>=2 then 'temperature' end], lambda x: x is not null), ',') as why from rv),
rev as (select *, case when n is null then 'not_comparable' when why<>'' then 'changed' else 'unchanged' end as status from rr)
"""


@query("revision", with_ctes(READINGS, NWP, _HOURLY, _REVISION) + """
, ff as (select station_id, issued_hour, case when hour(issued_hour)%5<>4 then hour(issued_hour)//2 end as f, issued_hour::date as m from iss),
fl as (select station_id, issued_hour, f is distinct from lag(f) over w as provider_updated, m is distinct from lag(m) over w as model_changed from ff window w as (partition by station_id order by issued_hour))
select station_id, case when n is not null then provider_updated end as provider_updated, case when n is not null then model_changed end as model_changed, epoch_us(issued_hour) as issued_us, status, coalesce(n,0) as common_valid_times, round(dp,2)+0.0 as dp, round(dt,2)+0.0 as dt,
 case when n is not null then round(shift,1)+0.0 end as shift, case when n is null then case when prev is null then 'missing_snapshot' else 'no_common_valid_times' end else why end as reasons from rev join fl using (station_id, issued_hour)""")
def revision(spark, sf):
    at = F.hour("issued_hour")
    hourly = _hourly(spark, sf).withColumns({
        "fetched_at": F.when(at % 5 != 4, F.floor(at / 2)), "model_version": F.to_date("issued_hour").cast("string")})
    out = V.compare_issues(hourly)
    return out.select(
        KEY, "provider_updated", F.col("model_or_postprocessing_changed").alias("model_changed"), F.unix_micros("issued_hour").alias("issued_us"), "status", "common_valid_times", rd("max_rain_probability_delta_points", 2).alias("dp"),
        rd("max_temperature_delta_c", 2).alias("dt"), rd("rain_window_shift_minutes", 1).alias("shift"), F.array_join("reasons", ",").alias("reasons"))


@query("revision_notices", _recursive(READINGS, NWP, _HOURLY, _REVISION, "nt as (select station_id, issued_hour as ts, 0 as seq, 'revision' as kind from rev where status='changed')",
       _GATE.format(kind="kind").replace("1800000000", "3600000000")) + "select station_id, epoch_us(ts) as ts_us, ok as accepted from gt")
def revision_notices(spark, sf):
    return V.revision_notices(V.compare_issues(_hourly(spark, sf))).select(KEY, ts_us("ts"), "accepted")


@query("snapshot_fingerprint", with_ctes(READINGS, NWP, _HOURLY) + """
select station_id, epoch_us(issued_hour) as issued_us, substr(sha256(string_agg(concat_ws(':', epoch_us(valid_at)::varchar, coalesce(printf('%.6f', temp), 'null'), coalesce(printf('%.6f', rain_prob), 'null')), '|' order by valid_at)), 1, 20) as snapshot_id
from hourly group by 1, 2""")
def snapshot_fingerprint(spark, sf):
    return V.snapshot_fingerprint(_hourly(spark, sf), [KEY, "issued_hour"], "valid_at", ["temp", "rain_prob"]).select(
        KEY, F.unix_micros("issued_hour").alias("issued_us"), "snapshot_id")


# The whole snapshot, with keys in their order, spelled out.
def _num(x):
    return f"coalesce(printf('%.6f', {x}::double), 'null')"


_CANONICAL = f"""
hr as (select station_id, issued_hour, string_agg('{{"condition":'||case when weathercode%2=1 then '"x'||weathercode||'"' else 'null' end||',"precip_mm":null,"rain_prob":'||{_num('rain_prob')}||',"temp":'||{_num('temp')}
   ||',"time":"'||strftime(valid_at, '%Y-%m-%dT%H:%M')||'","wind_kmh":'||{_num("lead_hours")}||'}}', ',' order by valid_at) as hourly from hourly group by 1,2),
dy as (select station_id, issued_hour, '{{"condition":null,"date":"'||strftime(issued_hour, '%Y-%m-%d')||'","precip_mm":null,"rain_prob_max":'||{_num('max(rain_prob)')}||',"temp_max":'||{_num('max(temp)')}||',"temp_min":'||{_num('min(temp)')}||'}}' as daily from hourly group by 1,2),
nc as (select station_id, issued_hour, string_agg('{{"lead_min":'||{_num('lead_hours*60')}||',"rain_prob":'||{_num('rain_prob/100')}||'}}', ',' order by valid_at) filter (where lead_hours<2) as nowcast from hourly group by 1,2),
tx as (select station_id, issued_hour, '{{"daily":['||daily||'],"hourly":['||hourly||'],"model_version":"v'||(station_id%2)||'","nowcast":['||nowcast||'],"source_status":{{"nwp":{{"fetched_at_utc":"'||strftime(issued_hour, '%Y-%m-%d')||'","status":"ready"}},"radar":{{"fetched_at_utc":null,"status":"off"}}}},"sources":null,"station":{{"lat":'||{_num('13.5+station_id')}||',"lon":100.500000}},"status":"ready"}}' as text
  from hr join dy using (station_id, issued_hour) join nc using (station_id, issued_hour))
"""


def _forecasts(spark, sf, turned):
    """Forecast objects; ``turned`` puts keys in another order, whole numbers for doubles, and adds what does not count."""
    order = reversed if turned else list
    pick = lambda *cols: F.struct(*order(cols))
    odd = F.when(F.col("weathercode") % 2 == 1, F.concat(F.lit("x"), F.col("weathercode").cast("string")))
    lead = F.col("lead_hours").cast("double" if turned else "int")
    hour = pick(F.date_format("valid_at", "yyyy-MM-dd'T'HH:mm").alias("time"), "temp", "rain_prob", odd.alias("condition"), lead.alias("wind_kmh"), *([F.minute("valid_at").alias("age")] if turned else []))
    now = pick((F.col("lead_hours") * 60).alias("lead_min"), (F.col("rain_prob") / 100).alias("rain_prob"))
    agg = _hourly(spark, sf).groupBy(KEY, "issued_hour").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("valid_at", hour.alias("e")))), lambda x: x["e"]).alias("hourly"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("lead_hours") < 2, F.struct("valid_at", now.alias("e"))))), lambda x: x["e"]).alias("nowcast"),
        F.array(pick(F.date_format(F.first("issued_hour"), "yyyy-MM-dd").alias("date"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), F.max("rain_prob").alias("rain_prob_max"))).alias("daily"))
    status = [F.lit("nwp"), pick(F.lit("ready").alias("status"), F.date_format("issued_hour", "yyyy-MM-dd").alias("fetched_at_utc")), F.lit("radar"), pick(F.lit("off").alias("status"), F.lit(None).cast("string").alias("fetched_at_utc"))]
    status = [*status[2:], *status[:2]] if turned else status
    return agg.select(
        KEY, "issued_hour", "hourly", "nowcast", "daily", F.create_map(*status).alias("source_status"), F.lit("ready").alias("status"),
        F.concat(F.lit("v"), (F.col(KEY) % 2).cast("string")).alias("model_version"), pick((F.lit(13.5) + F.col(KEY)).alias("lat"), F.lit(100.5).alias("lon")).alias("station"))


@query("snapshot_canonical", with_ctes(READINGS, NWP, _HOURLY, _CANONICAL) + "select station_id, epoch_us(issued_hour) as issued_us, substr(sha256(text), 1, 20) as snapshot_id, true as same from tx")
def snapshot_canonical(spark, sf):
    """Whole snapshots; the same contents with other key orders and types have the same identity."""
    one, other = (V.with_snapshot_id(_forecasts(spark, sf, t)).select(KEY, "issued_hour", F.col("snapshot_id").alias(f"id{t:d}")) for t in (False, True))
    both = one.join(other, [KEY, "issued_hour"])
    return both.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), F.col("id0").alias("snapshot_id"), (F.col("id0") == F.col("id1")).alias("same"))


@query("snapshot_repeats", with_ctes(READINGS) + """
, d as (select station_id, ts, rn, rn//3 as step, round(humidity/25)::int as h, case when (rn//3)%4=0 then null else round(light/60000) end as l, round(wind_direction/120) as w from readings),
l as (select *, row(step%2, first_value(h) over g, first_value(l) over g, first_value(w) over g) as v from d window g as (partition by station_id, step order by rn)),
p as (select *, lag(v) over (partition by station_id order by ts, rn) as pv, row_number() over (partition by station_id order by ts, rn) as i from l)
select station_id, epoch_us(ts) as ts_us, rn from p where i=1 or v is distinct from pv""")
def snapshot_repeats(spark, sf):
    """Readings whose assembled contents, nested and partly null, equal those just before."""
    g = Window.partitionBy(KEY, F.floor(F.col("rn") / 3)).orderBy("rn")
    step = F.floor(F.col("rn") / 3)
    r = readings(spark, sf).select(
        KEY, "ts", "rn", (step % 2).alias("a"), F.first(F.round(F.col("humidity") / 25).cast("int")).over(g).alias("h"),
        F.first(F.when(step % 4 != 0, F.round(F.col("light") / 60000))).over(g).alias("l"), F.first(F.round(F.col("wind_direction") / 120)).over(g).alias("w"))
    contents = F.struct(F.struct("w", "h").alias("air"), F.array("l").alias("light"), F.col("a"))
    return EN.drop_repeats(r, "ts", V.short_hash(V.canonical(contents))).select(KEY, ts_us("ts"), "rn")


# ---- warnings ----------------------------------------------------------------------------
_NOW = "2024-01-15 00:00:00"
_AREAS = f"""
stations as (select c_custkey as station_id, 13+(c_custkey%200)/100.0::double as lat, 100+((c_custkey*7)%200)/100.0::double as lon from customer),
warn as (select s_suppkey as warning_id, 13+(s_suppkey%5)*0.4::double as lat0, 100+(s_suppkey%5)*0.3::double as lon0,
  case (s_suppkey//3)%5 when 0 then 'Extreme' when 1 then 'Severe' when 2 then 'Moderate' else 'Minor' end as severity,
  case when s_suppkey%9=0 then 'Cancel' else 'Alert' end as msg_type, case when s_suppkey%4<>3 then timestamp '{_NOW}' + to_hours(s_suppkey%25-12) end as effective, timestamp '{_NOW}' + to_hours(s_suppkey%25-14) as sent,
  case when s_suppkey%10<>7 then timestamp '{_NOW}' + to_hours(s_suppkey%25-6) end as expires,
  case when s_suppkey%8=1 then 'ทั่วประเทศ' when s_suppkey%8=2 then 'near Bangkok' else 'inland' end as area_desc from supplier)
"""


def _stations(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias(KEY), (13 + k % 200 / 100.0).alias("lat"), (100 + k * 7 % 200 / 100.0).alias("lon"))


def _warnings(spark, sf):
    k = F.col("s_suppkey")
    r = F.floor(k / 3) % 5
    hour = F.lit(3_600_000_000).cast("long")
    now = F.unix_micros(F.expr(f"timestamp'{_NOW}'"))
    return table(spark, sf, "supplier").select(
        k.alias("warning_id"), (13 + k % 5 * 0.4).alias("lat0"), (100 + k % 5 * 0.3).alias("lon0"),
        F.when(r == 0, "Extreme").when(r == 1, "Severe").when(r == 2, "Moderate").otherwise("Minor").alias("severity"),
        F.when(k % 9 == 0, "Cancel").otherwise("Alert").alias("msg_type"), F.when(k % 4 != 3, F.timestamp_micros(now + (k % 25 - 12) * hour)).alias("effective"), F.timestamp_micros(now + (k % 25 - 14) * hour).alias("sent"),
        F.when(k % 10 != 7, F.timestamp_micros(now + (k % 25 - 6) * hour)).alias("expires"),
        F.when(k % 8 == 1, "ทั่วประเทศ").when(k % 8 == 2, "near Bangkok").otherwise("inland").alias("area_desc"))


def _area_rows(spark, sf):
    """Two info blocks per warning: a square (by text) and a triangle, then one without areas for every tenth."""
    w = _warnings(spark, sf)

    def corner(lat, lon):
        return F.concat(F.round(F.col("lat0") + lat, 4).cast("string"), F.lit(","), F.round(F.col("lon0") + lon, 4).cast("string"))

    square = F.concat_ws(" ", corner(0.0, 0.0), corner(0.0, 0.4), F.lit("bad"), corner(0.4, 0.4), corner(0.4, 0.0))
    triangle = F.concat_ws(" ", corner(0.8, 0.0), corner(0.8, 0.6), corner(1.4, 0.3))
    first = w.select("warning_id", F.lit(0).alias("info_index"), F.lit(0).alias("area_index"), "area_desc", W.parse_polygon(square).alias("ring"))
    second = w.select("warning_id", F.lit(1).alias("info_index"), F.lit(0).alias("area_index"), F.lit("x").alias("area_desc"), W.parse_polygon(triangle).alias("ring"))
    bare = w.filter("warning_id % 10 = 4").select("warning_id", F.lit(2).alias("info_index"), F.lit(None).cast("int").alias("area_index"),
                                                   F.lit("").alias("area_desc"), W.parse_polygon(F.lit("")).alias("ring"))
    return first.unionByName(second).unionByName(bare)


# Ray casting spelled out edge by edge.
def _cross(lat1, lon1, lat2, lon2):
    return f"case when (({lon1})>lon) <> (({lon2})>lon) and lat < ({lat1}) + (lon-({lon1}))*(({lat2})-({lat1}))/nullif(({lon2})-({lon1}),0) then 1 else 0 end"


def _ring(points):
    return "(" + " + ".join(_cross(*a, *b) for a, b in zip(points, points[1:] + points[:1])) + ")%2=1"


def _pt(dlat, dlon):
    return (f"round(lat0+{dlat},4)", f"round(lon0+{dlon},4)")


_SQUARE = _ring([_pt(0, 0), _pt(0, 0.4), _pt(0.4, 0.4), _pt(0.4, 0)])
_TRIANGLE = _ring([_pt(0.8, 0), _pt(0.8, 0.6), _pt(1.4, 0.3)])
_MATCH = f"""
pm as (select s.station_id, w.*, {_SQUARE} as sq, {_TRIANGLE} as tri from stations s cross join warn w),
ms as (select *, case when sq then 0 when area_desc in ('ทั่วประเทศ','near Bangkok') then 0 when tri then 1 when warning_id%10=4 then 2 end as info_index,
  case when sq then 'polygon' when area_desc='ทั่วประเทศ' then 'nationwide_area' when area_desc='near Bangkok' then 'configured_area_hint'
   when tri then 'polygon' when warning_id%10=4 then 'no_area' end as area_match from pm)
"""
_HINTS = ("Bangkok",)
# A country around all stations, with a bay that reaches among them.
_COUNTRY_RING = [(11.5, 98.2), (11.5, 104.1), (17.3, 104.1), (17.3, 98.2), (14.1, 98.2), (13.7, 101.1), (13.3, 98.2)]
_COUNTRY = _ring([(str(a), str(b)) for a, b in _COUNTRY_RING])


@query("warnings_match", with_ctes(_AREAS, _MATCH) + """
select station_id, warning_id, case when sq then 0 else 1 end as info_index, 'polygon' as area_match from pm where sq or tri
union all select null, warning_id, case when area_desc in ('ทั่วประเทศ','near Bangkok') then 0 else 2 end,
 case area_desc when 'ทั่วประเทศ' then 'nationwide_area' when 'near Bangkok' then 'configured_area_hint' else 'no_area' end
from warn where area_desc in ('ทั่วประเทศ','near Bangkok') or warning_id%10=4""")
def warnings_match(spark, sf):
    out = W.match_areas(_stations(spark, sf), _area_rows(spark, sf), _HINTS)
    return out.select(KEY, "warning_id", "info_index", "area_match")


_LIFE_SQL = f"""case when msg_type='Cancel' then 'cancelled' when expires is not null and timestamp '{_NOW}'>=expires then 'expired'
  when timestamp '{_NOW}'<coalesce(effective, sent) then 'scheduled' else 'active' end"""


def _life():
    return W.lifecycle(F.col("msg_type"), F.lit("actual"), F.col("effective"), F.col("expires"), F.expr(f"timestamp'{_NOW}'"), F.col("sent"))


@query("warnings_lifecycle", with_ctes(_AREAS) + f"select warning_id, severity, {_LIFE_SQL} as status from warn")
def warnings_lifecycle(spark, sf):
    return _warnings(spark, sf).select("warning_id", "severity", _life().alias("status"))


@query("warnings_shown", with_ctes(_AREAS, _MATCH) + f"""
, ac as (select *, {_LIFE_SQL} as status from ms where info_index is not null),
k as (select *, row_number() over (partition by station_id order by case severity when 'Extreme' then 0 when 'Severe' then 1 when 'Moderate' then 2 else 3 end, expires nulls last, warning_id) as position
  from ac where status='active')
select station_id, position, warning_id, severity, area_match from k where position<=3""")
def warnings_shown(spark, sf):
    live = _warnings(spark, sf).filter(_life() == "active").drop("lat0", "lon0", "area_desc")
    stations = _stations(spark, sf)
    return W.shown_in(stations, W.match_cells(_area_rows(spark, sf), _HINTS), live.select("warning_id", "severity", "expires"), 3).select(KEY, "position", "warning_id", "severity", "area_match")


@query("warnings_cells", with_ctes(_AREAS) + f"""
, pm as (select w.*, count(*) filter (where {_SQUARE}) as n0, count(*) filter (where {_TRIANGLE}) as n1, count(*) filter (where {_COUNTRY}) as n2 from stations s cross join warn w group by all)
select warning_id, unnest([0,1,2]) as info_index, unnest([n0,n1,case when warning_id%10=0 then n2 else 0 end]) as n_stations from pm""")
def warnings_cells(spark, sf):
    """Stations under each polygon, one in ten a country's; whole cells are counted, not their stations."""
    w = _warnings(spark, sf)
    country = w.filter("warning_id % 10 = 0").select(
        "warning_id", F.lit(2).alias("info_index"), F.lit(0).alias("area_index"), F.lit("x").alias("area_desc"),
        W.parse_polygon(F.lit(" ".join(f"{lat},{lon}" for lat, lon in _COUNTRY_RING))).alias("ring"))
    cells = W.match_cells(_area_rows(spark, sf).unionByName(country), ())
    counts = W.stations_in(_stations(spark, sf), cells).select("warning_id", "info_index", "n_stations")
    every = w.select("warning_id", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2)])).alias("info_index"))
    return every.join(counts, ["warning_id", "info_index"], "left").select("warning_id", "info_index", F.coalesce("n_stations", F.lit(0)).alias("n_stations"))


@query("warning_urls", "select distinct 'cap/'||(s_suppkey%70) as url from supplier where s_suppkey%6<>0")
def warning_urls(spark, sf):
    k = F.col("s_suppkey")
    items = table(spark, sf, "supplier").select(F.when(k % 6 != 0, F.concat(F.lit("cap/"), (k % 70).cast("string"))).alias("url"), k.alias("id"))
    return W.distinct_urls(items).select("url")


# ---- radar -------------------------------------------------------------------------------
# Rain fields over five frames in a window of 300 x 300 pixels, a region per 400 parts: in one of five the newest frames
# are dry, one has a single frame.
_PIXELS = """
spots as (select p_partkey//400 as region, p_partkey%400 as k, p_size from part),
pixels as (select region, f*600 as frame_time, (k*37)%260+(2+2*(region%5))*f as x, (k*k*7+k*89)%260+4*f as y, max(1+p_size%4) as bucket
  from spots cross join (select unnest(range(0,5)) as f) where region%5<3 or (region%5=3 and f<3) or (region%5=4 and f=4) group by 1,2,3,4)
"""


def _pixels(spark, sf):
    region, k, f = F.col("region"), F.col("k"), F.col("f")
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 400).alias("region"), (F.col("p_partkey") % 400).alias("k"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("f"))
    p = p.filter((region % 5 < 3) | ((region % 5 == 3) & (f < 3)) | ((region % 5 == 4) & (f == 4)))
    return p.groupBy(
        region.cast("long").alias("region"), (f * 600).alias("frame_time"),
        (k * 37 % 260 + (2 + 2 * (region % 5)) * f).cast("int").alias("x"), ((k * k * 7 + k * 89) % 260 + 4 * f).cast("int").alias("y"),
    ).agg(F.max(1 + F.col("p_size") % 4).cast("int").alias("bucket"))


_CX, _CY, _LAT = 150, 150, 13.8692387
_RING_SQL = ", ".join(f"coalesce(max(bucket) filter (where km>{a} and km<={b}),0)::int as {n}" for n, a, b in
                      (("intensity_0_10km", 0, 10), ("intensity_10_25km", 10, 25), ("intensity_25_50km", 25, 50), ("intensity_50_100km", 50, 100)))
_RINGS_CTE = f"""
kp as (select *, sqrt((x-{_CX})**2+(y-{_CY})**2)*156543.03392*cos(radians({_LAT}))/128/1000 as km from pixels),
rg as (select region, frame_time, {_RING_SQL}, coalesce(max(bucket) filter (where x={_CX} and y={_CY}),0)::int as point_intensity,
  coalesce(max(bucket) filter (where x>=128 and x<176 and y>=128 and y<176),0)::int as nearby_max_intensity from kp group by 1,2),
rings as (select *, greatest(intensity_0_10km, intensity_10_25km) as close_max_intensity from rg)
"""
_RING_COLS = "intensity_0_10km, intensity_10_25km, intensity_25_50km, intensity_50_100km, point_intensity, nearby_max_intensity, close_max_intensity"


def _rings(spark, sf):
    return R.ring_maxima(_pixels(spark, sf), ["region"], F.lit(_CX), F.lit(_CY), meters_per_pixel(F.lit(_LAT)), home=(128, 176, 128, 176))


@query("radar_rings", with_ctes(_PIXELS, _RINGS_CTE) + f"select region, frame_time, {_RING_COLS} from rings")
def radar_rings(spark, sf):
    return _rings(spark, sf).select("region", "frame_time", *_RING_COLS.split(", "))


@query("radar_trend", with_ctes(_PIXELS, _RINGS_CTE) + """
, t as (select *, lag(close_max_intensity) over (partition by region order by frame_time) as pv, row_number() over (partition by region order by frame_time desc) as k,
   first_value(close_max_intensity) over (partition by region order by frame_time) as f0 from rings)
select region, max(frame_time) as frame_time, max(case when k=1 then close_max_intensity end) as close_max_intensity,
 coalesce(bool_and(coalesce(pv<=close_max_intensity,true)) and max(case when k=1 then close_max_intensity end)>max(f0) and count(*)>=2, false) as trend_rising from t group by 1""")
def radar_trend(spark, sf):
    return R.ring_trend(_rings(spark, sf), ["region"]).select("region", "frame_time", "close_max_intensity", "trend_rising")


_GRID = GridPolicy(frames=4)
# Motion by brute force over all wet pixel pairs within the shift range.
_MOTION = """
wp as (select * from pixels where x>=0 and x<300 and y>=0 and y<300),
ft as (select region, frame_time, lead(frame_time) over (partition by region order by frame_time) as nt from (select r.region, f.frame_time from (select distinct region from pixels) r, (select distinct frame_time from pixels order by 1 desc limit 4) f)),
ne as (select distinct region, frame_time from wp),
ok as (select ft.* from ft join ne a on a.region=ft.region and a.frame_time=ft.frame_time join ne b on b.region=ft.region and b.frame_time=ft.nt),
sc as (select a.region, a.frame_time, b.x-a.x as dx, b.y-a.y as dy, count(*) as n from wp a join ok on ok.region=a.region and ok.frame_time=a.frame_time
  join wp b on b.region=a.region and b.frame_time=ok.nt and abs(b.x-a.x)<=30 and abs(b.y-a.y)<=30 and (b.x-a.x)%2=0 and (b.y-a.y)%2=0 group by 1,2,3,4),
bs as (select *, row_number() over (partition by region, frame_time order by n desc, (dx<>0 or dy<>0), dy, dx) as k from sc),
mv as (select ok.region, ok.frame_time, coalesce(dx,0)::int as dx, coalesce(dy,0)::int as dy, coalesce(n,0) as overlap from ok left join bs on bs.region=ok.region and bs.frame_time=ok.frame_time and bs.k=1)
"""


def _shifts(spark, sf):
    px = _pixels(spark, sf)
    cropped = R.crop(px, F.lit(_CX), F.lit(_CY), _GRID)
    times = F.explode(F.sequence(F.lit(0), F.lit(2400), F.lit(600)))
    frames = px.select("region").distinct().withColumn("frame_time", times)
    return cropped, frames, R.motion(cropped, ["region"], frames, _GRID)


@query("radar_motion", with_ctes(_PIXELS, _MOTION) + "select region, frame_time, dx, dy, overlap from mv")
def radar_motion(spark, sf):
    return _shifts(spark, sf)[2].select("region", "frame_time", "dx", "dy", "overlap")


_ETA = """
vl as (select region, avg(dx/10.0::double) as vx, avg(dy/10.0::double) as vy, count(*) as pairs, stddev_pop(dx/10.0::double)+stddev_pop(dy/10.0::double) as spread from mv group by 1),
sp as (select *, sqrt(vx*vx+vy*vy) as speed from vl),
st as (select sp.*, t, cast(round_even(150-vx*t,0) as int) as sx, cast(round_even(150-vy*t,0) as int) as sy from sp cross join (select unnest(range(0,121,5)) as t)),
hz as (select st.region, min(t) filter (where sx<0 or sy<0 or sx>=300 or sy>=300) as edge, min(case when p.bucket is not null then t*10+p.bucket end) as hit
  from st left join wp p on p.region=st.region and p.frame_time=2400 and p.x=st.sx and p.y=st.sy group by 1),
et as (select sp.*, hit is not null and (edge is null or hit//10<edge) and speed>1e-6 as arr, hit from sp join hz on hz.region=sp.region)
"""


@query("radar_eta", with_ctes(_PIXELS, _MOTION, _ETA) + """
select region, pairs, round(vx,6)+0.0 as vx, round(vy,6)+0.0 as vy, arr as rain_arriving, case when arr then (hit//10)::int end as eta_minutes, case when arr then (hit%10)::int end as expected_intensity,
 cast(round_even((degrees(atan2(vx,-vy))+360)%360,0) as int) as motion_deg, round(speed*156543.03392*cos(radians(13.8692387))/128/1000*60,1)+0.0 as motion_kmh,
 round(greatest(0.0,least(1.0, case when pairs>=2 then greatest(0.0,1-spread/greatest(speed,1e-6)) else 0.5 end * pairs/3)),2)+0.0 as confidence
 from et where exists (select 1 from wp where wp.region=et.region and wp.frame_time=2400)
union all select region, null, null, null, false, null, null, null, null, 0.0 from (select distinct region from pixels) r
 where region not in (select region from mv) or not exists (select 1 from wp where wp.region=r.region and wp.frame_time=2400)""")
def radar_eta(spark, sf):
    cropped, frames, shifts = _shifts(spark, sf)
    speed = R.velocity(shifts, ["region"], 4, meters_per_pixel(F.lit(_LAT)))
    out = R.outlook(cropped, frames, speed, ["region"], F.lit(_CX), F.lit(_CY), F.lit(_GRID.window), F.lit(_GRID.window), _GRID)
    return out.select("region", "pairs", rd("vx").alias("vx"), rd("vy").alias("vy"), "rain_arriving", F.col("eta_minutes").cast("int").alias("eta_minutes"),
                      "expected_intensity", "motion_deg", rd("motion_kmh", 1).alias("motion_kmh"), rd("confidence", 2).alias("confidence"))


# ---- cloud trend and blend ---------------------------------------------------------------
@query("cloud_trend", with_ctes(READINGS, NWP) + """
, c as (select *, lag(precipitation_probability) over (partition by station_id, issued_hour order by valid_at) as pv from nwp_log where lead_hours<3)
select station_id, epoch_us(issued_hour) as issued_us, bool_and(coalesce(pv<=precipitation_probability,true)) and arg_max(precipitation_probability, valid_at) > arg_min(precipitation_probability, valid_at) as trend_rising,
 max(precipitation_probability) filter (where lead_hours=1) as next_hour from c group by 1,2""")
def cloud_trend(spark, sf):
    from ..operators.alerts import rising

    h = nwp_log(spark, sf).filter("lead_hours < 3").withColumnRenamed("precipitation_probability", "cover")
    out = h.groupBy(KEY, "issued_hour").agg(
        *rising("cover", "valid_at", [KEY, "issued_hour"], 3, positive=False), F.max(F.when(F.col("lead_hours") == 1, F.col("cover"))).alias("next_hour"))
    return out.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), "trend_rising", "next_hour")


_BLEND = """
lf as (select station_id, max(issued_at) as at_ from forecast_log where source_layer='local_rf' group by 1),
nc as (select f.station_id, 'nowcast' as layer, source_layer as source, lead_minutes::int as lead_minutes, rain_prob from forecast_log f join lf on lf.station_id=f.station_id and f.issued_at=lf.at_ and source_layer='local_rf'),
ar as (select station_id, 'arrival', 'radar_advection', lead_minutes::int, null::double from (select *, row_number() over (partition by station_id order by issued_at desc) as k from forecast_log where source_layer='radar_advection') where k=1 and rain_prob>0.4),
hi as (select station_id, max(issued_hour) as at_ from nwp_log group by 1),
hr as (select n.station_id, 'hourly', 'nwp', (lead_hours*60)::int, precipitation_probability from nwp_log n join hi on hi.station_id=n.station_id and n.issued_hour=hi.at_),
dy as (select n.station_id, 'daily', 'nwp', (lead_hours*1440)::int, precipitation_probability from nwp_log n join hi on hi.station_id=n.station_id and n.issued_hour=hi.at_ where lead_hours<3),
bl as (select * from nc union all select * from ar union all select * from hr union all select * from dy)
"""


def _layers(spark, sf):
    f = forecast_log(spark, sf)
    local = f.filter("source_layer = 'local_rf'")
    newest = local.groupBy(KEY).agg(F.max("issued_at").alias("issued_at"))
    nowcast = local.join(newest, [KEY, "issued_at"]).select(KEY, "lead_minutes", "rain_prob", F.col("source_layer").alias("source"))
    radar = f.filter("source_layer = 'radar_advection'").groupBy(KEY).agg(
        F.max_by("lead_minutes", "issued_at").alias("eta_minutes"), F.max_by("rain_prob", "issued_at").alias("confidence"))
    arrival = radar.select(KEY, "eta_minutes", F.lit(2).alias("expected_intensity"), "confidence", (F.col("confidence") > 0.4).alias("rain_arriving"))
    n = nwp_log(spark, sf)
    n = n.join(n.groupBy(KEY).agg(F.max("issued_hour").alias("issued_hour")), [KEY, "issued_hour"])
    hourly = n.select(KEY, "lead_hours", F.col("temp_forecast").alias("temp"), F.col("precipitation_probability").alias("rain_prob"))
    daily = n.filter("lead_hours < 3").select(KEY, F.col("lead_hours").alias("day_index"), F.lit(20.0).alias("temp_min"), F.lit(30.0).alias("temp_max"),
                                              F.col("precipitation_probability").alias("rain_prob_max"))
    return B.layers(nowcast, arrival, hourly, daily)


@query("forecast_blend", with_ctes(READINGS, FORECASTS, NWP, _BLEND) + "select station_id, layer, source, lead_minutes, round(rain_prob,6)+0.0 as rain_prob from bl")
def forecast_blend(spark, sf):
    return _layers(spark, sf).select(KEY, "layer", "source", "lead_minutes", rd("rain_prob").alias("rain_prob"))


@query("source_status", with_ctes(READINGS, FORECASTS, NWP, _BLEND) + """
select s.station_id, case when bool_or(layer='nowcast') then 'ready' else 'unavailable' end as local, case when bool_or(layer in ('hourly','daily')) then 'ready' else 'unavailable' end as nwp,
 case when bool_or(layer='arrival') then 'ready' else 'unavailable' end as radar, case when bool_or(layer='nowcast') then 'ready' when count(layer)>0 then 'partial' else 'unavailable' end as status
from (select unnest(range(0,5)) as station_id) s left join bl on bl.station_id=s.station_id group by 1""")
def source_status(spark, sf):
    users = table(spark, sf, "events").select((F.col("user_id") % 5).alias(KEY)).distinct()
    return B.source_status(_layers(spark, sf), users)


@query("forecast_object", with_ctes(READINGS, FORECASTS, NWP, _BLEND) + """
, nw as (select station_id, max(ts) as ts, arg_max(temp, (ts, rn)) as temp from readings group by 1),
ob as (select station_id,
  coalesce(string_agg(lead_minutes||':'||source||':'||printf('%.4f', rain_prob), ' ' order by lead_minutes, source, rain_prob) filter (where layer='nowcast'), '') as nowcast,
  coalesce(string_agg(lead_minutes||':'||source||':'||printf('%.4f', rain_prob), ' ' order by lead_minutes, source, rain_prob) filter (where layer='hourly'), '') as hourly,
  coalesce(string_agg(lead_minutes||':'||source||':'||printf('%.4f', rain_prob), ' ' order by lead_minutes, source, rain_prob) filter (where layer='daily'), '') as daily,
  coalesce(string_agg(distinct source, ',' order by source) filter (where layer='nowcast'), '') as nowcast_sources,
  max(source) filter (where layer='daily') as daily_source, max(lead_minutes) filter (where layer='arrival') as eta from bl group by 1)
select ob.*, epoch_us(nw.ts) as now_us, round(nw.temp,4)+0.0 as now_temp, case when station_id%2=0 then 'high' else 'low' end as level,
 case when station_id%2=0 then 'fresh' else 'no local sensor model' end as reason from ob left join nw using (station_id)""")
def forecast_object(spark, sf):
    r = readings(spark, sf)
    now = r.groupBy(KEY).agg(F.max("ts").alias("ts"), F.max_by("temp", F.struct("ts", "rn")).alias("temp"))
    sure = r.filter(F.col(KEY) % 2 == 0).groupBy(KEY).agg(F.lit("high").alias("level"), F.lit(1.0).alias("data_confidence"), F.lit("fresh").alias("reason"))
    o = B.forecast_object(_layers(spark, sf), now, sure)

    def shown(layer):
        row = lambda x: F.concat_ws(":", x["lead_minutes"].cast("string"), x["source"], F.format_string("%.4f", x["rain_prob"]))
        return F.array_join(F.transform(layer, row), " ").alias(layer)

    return o.select(
        KEY, shown("nowcast"), shown("hourly"), shown("daily"), F.array_join("sources.nowcast", ",").alias("nowcast_sources"), F.col("sources.daily").alias("daily_source"),
        F.try_element_at(F.col("arrival"), F.lit(1))["lead_minutes"].alias("eta"), F.unix_micros("now.ts").alias("now_us"), rd("now.temp", 4).alias("now_temp"),
        F.col("confidence.level").alias("level"), F.col("confidence.reason").alias("reason"))


@query("forecast_object_rain", with_ctes(READINGS, FORECASTS, NWP, _BLEND) + f"""
select s.station_id, s.n as nowcasts, rs.status, rs.elapsed_minutes, rs.remaining_median, rs.completed_events, coalesce(s.n,0)>0 and rs.status='not_raining' as calm
from (select station_id, count(*) filter (where layer='nowcast') as n from bl group by 1) s
left join (select * from ({QUERIES["rain_stop"].oracle}) where station_id<>2) rs on rs.station_id=s.station_id""")
def forecast_object_rain(spark, sf):
    """The forecast object with its rain-stop part; one station has none."""
    h = _cut_history(spark, sf).filter(F.col(KEY) != 2)
    latest = h.groupBy(KEY).agg(F.max("ts").alias("_l"))
    clock = latest.select(KEY, F.when(F.col(KEY) == 3, F.expr("_l + interval 3 minutes")).otherwise(F.col("_l")).alias("now"))
    o = B.forecast_object(_layers(spark, sf), rain_stop=RE.rain_stop_at(h, clock))
    return o.select(
        KEY, F.size("nowcast").cast("long").alias("nowcasts"), F.col("rain_stop.status").alias("status"), rd("rain_stop.elapsed_minutes", 2).alias("elapsed_minutes"),
        rd("rain_stop.remaining_median", 1).alias("remaining_median"), F.col("rain_stop.completed_events").alias("completed_events"),
        ((F.size("nowcast") > 0) & (F.col("rain_stop.status") == "not_raining")).alias("calm"))
