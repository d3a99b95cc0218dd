"""As-of and tolerance joins, and the scoring built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import scoring as S
from ..operators import daily as DS
from ..operators.chunks import KEY
from ..operators.lineage import fresh_path
from .fixtures import FORECASTS, NWP, READINGS, forecast_log, nwp_log, readings, with_ctes
from .registry import query, rd, sql_rd, ts_us

PAYLOAD = ["lead_hours", "temp_forecast", "precipitation_probability"]


@query("asof_nwp", with_ctes(READINGS, NWP) + """
select station_id, ts_us, valid_us, issued_us, lead, temp, prob, age from (
 select r.station_id, epoch_us(r.ts) as ts_us, epoch_us(n.valid_at) as valid_us, epoch_us(n.issued_hour) as issued_us,
  n.lead_hours as lead, round(n.temp_forecast,4)+0.0 as temp, round(n.precipitation_probability,4)+0.0 as prob,
  round((epoch_us(r.ts)-epoch_us(n.issued_hour))/1e6,3)+0.0 as age,
  row_number() over (partition by r.station_id, r.ts order by n.valid_at desc nulls last, n.issued_hour desc) as k
 from readings r left join nwp_log n on n.station_id=r.station_id and n.issued_hour<=r.ts and n.valid_at<=r.ts and n.valid_at>=r.ts - interval 6 hours) where k=1""")
def asof_nwp(spark, sf):
    log = nwp_log(spark, sf).withColumnRenamed("issued_hour", "issued_at")
    df = A.asof_known(readings(spark, sf).select(KEY, "ts", "temp"), log, PAYLOAD)
    return df.select(
        KEY, ts_us("ts"), F.unix_micros("nwp_valid_at").alias("valid_us"), F.unix_micros("nwp_issued_at").alias("issued_us"),
        F.col("nwp_lead_hours").alias("lead"), rd("nwp_temp_forecast", 4).alias("temp"),
        rd("nwp_precipitation_probability", 4).alias("prob"), rd("nwp_age_seconds", 3).alias("age"),
    )


NEAREST = """
near as (select n.*, r.temp, r.ts as matched_at, row_number() over (partition by n.station_id, n.issued_hour, n.lead_hours
    order by abs(epoch_us(r.ts)-epoch_us(n.valid_at)), r.ts) as k
  from nwp_log n left join readings r on r.station_id=n.station_id and abs(epoch_us(r.ts)-epoch_us(n.valid_at))<=480000000)
"""


@query("nearest_obs", with_ctes(READINGS, NWP, NEAREST) + """
select station_id, epoch_us(issued_hour) as issued_us, lead_hours, epoch_us(matched_at) as matched_us, round(temp,4)+0.0 as temp
from near where k=1""")
def nearest_obs(spark, sf):
    df = A.nearest_within(nwp_log(spark, sf), "valid_at", readings(spark, sf), "ts", "temp", 480.0)
    return df.select(
        KEY, F.unix_micros("issued_hour").alias("issued_us"), "lead_hours",
        F.unix_micros("matched_at").alias("matched_us"), rd("temp", 4).alias("temp"),
    )


# Point truth by brute force over the three minute buckets.
POINT = """
ptc as (select f.*, r.rain_flag, abs(epoch_us(r.ts)-epoch_us(f.valid_at)) as d,
   row_number() over (partition by f.station_id, f.issued_at, f.lead_minutes order by abs(epoch_us(r.ts)-epoch_us(f.valid_at)),
     case when date_trunc('minute', r.ts) = date_trunc('minute', f.valid_at) then 0
          when r.ts < f.valid_at then 1 else 2 end, r.ts) as k
  from forecast_log f left join readings r on r.station_id=f.station_id
   and date_trunc('minute', r.ts) between date_trunc('minute', f.valid_at) - interval 1 minute and date_trunc('minute', f.valid_at) + interval 1 minute
  where f.source_layer = 'radar_advection'),
pt as (select *, case when d<=90000000 then cast(rain_flag>0.1 as int) end as actual from ptc where k=1)
"""
# Window truth by stepping through the minutes and never reusing the last reading.
WINDOW = """
cand as (select f.station_id, f.issued_at, f.lead_minutes, m.k, epoch_us(r.ts) as us, r.rain_flag>0.1 as wet,
    abs(epoch_us(r.ts)-epoch_us(f.issued_at)-m.k*60000000::bigint) as d
  from forecast_log f join (select unnest(range(1,31)) as k) m on m.k<=f.lead_minutes
  join readings r on r.station_id=f.station_id and abs(epoch_us(r.ts)-epoch_us(f.issued_at)-m.k*60000000::bigint)<=30000000
   and r.ts>f.issued_at and epoch_us(r.ts)<=epoch_us(f.valid_at)+30000000
  where f.source_layer='local_rf'),
cn as (select station_id, issued_at, lead_minutes, k, list({'d':d,'us':us,'wet':wet} order by d, us) as c from cand group by 1,2,3,4),
walk as (
  select station_id, issued_at, lead_minutes, 1 as k, c[1].us as last_us, c[1].wet as wet from cn where k=1
  union all
  select station_id, issued_at, lead_minutes, k, pick.us, wet or pick.wet from (
    select w.station_id, w.issued_at, w.lead_minutes, cn.k, w.wet, list_filter(cn.c, lambda x: x.us <> w.last_us)[1] as pick
    from walk w join cn on cn.station_id=w.station_id and cn.issued_at=w.issued_at and cn.lead_minutes=w.lead_minutes and cn.k=w.k+1)
  where pick is not null),
wt as (select f.*, cast(w.wet as int) as actual from forecast_log f
   left join walk w on w.station_id=f.station_id and w.issued_at=f.issued_at and w.lead_minutes=f.lead_minutes and w.k=f.lead_minutes
   where f.source_layer='local_rf')
"""


def _recursive(*ctes: str) -> str:
    return with_ctes(*ctes).replace("with ", "with recursive ", 1)


_TRUTH_COLS = "station_id, epoch_us(issued_at) as issued_us, cast(lead_minutes as int) as lead_minutes, source_layer, actual"


def _truth(df):
    return df.select(KEY, F.unix_micros("issued_at").alias("issued_us"), F.col("lead_minutes").cast("int").alias("lead_minutes"), "source_layer", "actual")


@query("match_point", with_ctes(READINGS, FORECASTS, POINT) + f"select {_TRUTH_COLS} from pt")
def match_point(spark, sf):
    f = forecast_log(spark, sf).filter("source_layer = 'radar_advection'")
    return _truth(A.match_point(f, readings(spark, sf)))


@query("match_window", _recursive(READINGS, FORECASTS, WINDOW) + f"select {_TRUTH_COLS} from wt")
def match_window(spark, sf):
    f = forecast_log(spark, sf).filter("source_layer = 'local_rf'")
    return _truth(A.match_window(f, readings(spark, sf)))


def _rates_sql() -> str:
    rows = [f"({lead},{h},{r})" for lead, rates in S.WINDOW_RATES.items() for h, r in enumerate(rates)]
    points = [f"({h},{r})" for h, r in enumerate(S.POINT_RATES)]
    return (f"wr(lead,h,rate) as (values {','.join(rows)}),\npr(h,rate) as (values {','.join(points)})")


CLIMATE = _rates_sql() + """,
truth as (select station_id, issued_at, valid_at, lead_minutes, rain_prob, source_layer, actual from wt
  union all select station_id, issued_at, valid_at, lead_minutes, rain_prob, source_layer, actual from pt),
graded as (select t.*, case when source_layer='local_rf' then wr.rate else pr.rate end::double as climatology from truth t
  left join wr on wr.lead=t.lead_minutes and wr.h=hour(t.issued_at)
  left join pr on pr.h=hour(t.valid_at + interval 7 hours))
"""
_GRADED = (READINGS, FORECASTS, POINT, WINDOW, CLIMATE)


@query("climatology", with_ctes(READINGS, FORECASTS, _rates_sql()) + """
select station_id, epoch_us(issued_at) as issued_us, cast(lead_minutes as int) as lead_minutes, source_layer,
  round((case when source_layer='local_rf' then wr.rate else pr.rate end)::double, 9)+0.0 as climatology
from forecast_log t left join wr on wr.lead=t.lead_minutes and wr.h=hour(t.issued_at)
  left join pr on pr.h=hour(t.valid_at + interval 7 hours)""")
def climatology(spark, sf):
    f = forecast_log(spark, sf)
    rate = S.climatology_rate(
        S.is_window_layer(F.col("source_layer")), F.unix_micros("issued_at"), F.unix_micros("valid_at"), F.col("lead_minutes")
    )
    return f.select(KEY, F.unix_micros("issued_at").alias("issued_us"), F.col("lead_minutes").cast("int").alias("lead_minutes"), "source_layer", rd(rate, 9).alias("climatology"))


_SCORE_SQL = """select station_id, source_layer, cast(lead_minutes as int) as lead_minutes, n, round(b,12)+0.0 as brier_score, round(c,12)+0.0 as climatology_brier,
 round(case when c>0 then 1-b/c end,5)+0.0 as skill_score, round(mp,12)+0.0 as mean_predicted, round(mo,12)+0.0 as mean_observed
from (select station_id, source_layer, lead_minutes, count(*) as n, avg((rain_prob-actual)**2) as b,
 case when count(climatology)=count(*) then avg((climatology-actual)**2) end as c, avg(rain_prob) as mp, avg(actual) as mo
 from graded where actual is not null {where} group by 1,2,3)"""


def _scores(df):
    return df.select(
        KEY, "source_layer", F.col("lead_minutes").cast("int").alias("lead_minutes"), "n",
        *[rd(c, 12).alias(c) for c in ("brier_score", "climatology_brier", "mean_predicted", "mean_observed")],
        rd("skill_score", 5).alias("skill_score"),
    )


@query("forecast_score", _recursive(*_GRADED) + _SCORE_SQL.format(where=""))
def forecast_score(spark, sf):
    graded = S.with_truth(forecast_log(spark, sf), readings(spark, sf))
    return _scores(S.score(graded))


# A scoring time inside the data, so that the trailing day is a proper subset.
NOW = "2024-01-02 12:00:00"


@query("forecast_score_recent", _recursive(*_GRADED) + _SCORE_SQL.format(where=f"""
 and issued_at >= timestamp '{NOW}' - interval 121 minutes - interval 30 seconds - interval 1 day
 and issued_at < timestamp '{NOW}' - interval 121 minutes - interval 30 seconds"""))
def forecast_score_recent(spark, sf):
    return _scores(S.score_recent(forecast_log(spark, sf), readings(spark, sf), F.expr(f"timestamp'{NOW}'")))


@query("daywise_score", _recursive(*_GRADED) + _SCORE_SQL.format(where=""))
def daywise_score(spark, sf):
    """Scores of all history from stored states of its issue days."""
    folder = fresh_path(spark, "score-states")
    graded = S.with_truth(forecast_log(spark, sf), readings(spark, sf))
    DS.add_days(graded, folder, DS.day_of("issued_at"), lambda df, by: S.score_state(df, [*by, KEY, "source_layer", "lead_minutes"]))
    return _scores(S.score_of_states(DS.states(spark, folder)))
