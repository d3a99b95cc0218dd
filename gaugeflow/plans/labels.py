"""Label, split and sample-weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.chunks import KEY
from .fixtures import READINGS, KEPT, predictions, predictions_sql, readings, with_ctes
from .registry import query, rd, ts_us
from .series import SERIES

HS = (5, 10, 30, 60, 120)


def _future(h: int, value: str) -> str:
    f = f"(partition by station_id, segment_id order by ts rows between 1 following and {h} following)"
    el = f"epoch_us(lead(ts,{h}) over (partition by station_id, segment_id order by ts)) - epoch_us(ts)"
    return (f"case when count(*) over {f} = {h} and abs({el} - {h * 60000000}) <= 30000000"
            f" and max(observation_gap_filled) over {f} <= 0 then cast(max({value}) over {f} > 0.1 as int) end")


_P60 = "(partition by station_id, segment_id order by ts rows between 60 preceding and 1 preceding)"
ONSETS = f"""
ons as (select *, case when rain_flag>0.1 and observation_gap_filled=0 and count(*) over {_P60}=60
   and max(rain_flag) over {_P60}<=0.1 and max(observation_gap_filled) over {_P60}<=0
   and abs(epoch_us(ts)-epoch_us(lag(ts,60) over (partition by station_id, segment_id order by ts))-3600000000)<=30000000
   then 1 else 0 end as onset from rseg)
"""


@query("label_window", with_ctes(*SERIES) + "select station_id, epoch_us(ts) as ts_us, "
       + ", ".join(f"{_future(h, 'rain_flag')} as rain_{h}m" for h in HS) + " from rseg")
def label_window(spark, sf):
    df = L.label_rows(readings(spark, sf).drop("rn"), HS, onset=False)
    return df.select(KEY, ts_us("ts"), *[f"rain_{h}m" for h in HS])


@query("label_onset", with_ctes(*SERIES, ONSETS) + "select station_id, epoch_us(ts) as ts_us, onset, "
       + ", ".join(f"{_future(h, 'onset')} as onset_{h}m" for h in HS) + " from ons")
def label_onset(spark, sf):
    df = L.label_rows(readings(spark, sf).drop("rn"), HS)
    return df.select(KEY, ts_us("ts"), "onset", *[f"onset_{h}m" for h in HS])


@query("split_purged", with_ctes(READINGS, KEPT, predictions_sql(10)) + """
, o as (select *, row_number() over (partition by station_id order by ts)-1 as i, count(*) over (partition by station_id) as n from pred10),
p as (select *, case when i<floor(n*0.6::double) then 1 when i<floor(n*0.7::double) then 2 when i<floor(n*0.8::double) then 3 else 4 end as part from o),
s as (select station_id, part, min(epoch_us(ts)) as start_us from p group by 1,2)
select p.station_id, epoch_us(p.ts) as ts_us, (['train','calibration','validation','test'])[p.part] as part
from p left join s on s.station_id=p.station_id and s.part=p.part+1
where s.start_us is null or epoch_us(p.ts)+630000000 < s.start_us""")
def split_purged(spark, sf):
    return L.split(predictions(spark, sf, 10), 10).select(KEY, ts_us("ts"), "part")


@query("onset_weights", with_ctes(READINGS, KEPT, predictions_sql(30)) + """
, t as (select p.*, r.humidity, coalesce(lag(observed) over (partition by p.station_id order by p.ts),0) as before
        from pred30 p join readings r on p.station_id=r.station_id and p.ts=r.ts),
e as (select *, sum(case when observed=1 and before=0 then 1 else 0 end) over (partition by station_id order by ts) as ep from t),
z as (select station_id, ep, count(*) as size from e where observed=1 group by 1,2),
m as (select station_id, sum(size)/count(*) as mass from z group by 1)
select e.station_id, epoch_us(e.ts) as ts_us,
  round(case when observed=1 then m.mass/z.size when humidity>=85 then 1.5 else 1.0 end,6)+0.0 as weight
from e left join z on z.station_id=e.station_id and z.ep=e.ep and e.observed=1 left join m on m.station_id=e.station_id""")
def onset_weights(spark, sf):
    p = predictions(spark, sf, 30).withColumnRenamed("observed", "target")
    h = readings(spark, sf).select(KEY, "ts", "humidity")
    return L.onset_weights(p.join(h, [KEY, "ts"])).select(KEY, ts_us("ts"), rd("weight").alias("weight"))


@query("onset_weights_light", with_ctes(READINGS, KEPT, predictions_sql(30)) + """
, t as (select p.*, r.humidity, case when r.light is null then null else (r.rn%7)-3.0 end as slope, coalesce(lag(observed) over (partition by p.station_id order by p.ts),0) as before
        from pred30 p join readings r on p.station_id=r.station_id and p.ts=r.ts),
e as (select *, sum(case when observed=1 and before=0 then 1 else 0 end) over (partition by station_id order by ts) as ep from t),
z as (select station_id, ep, count(*) as size from e where observed=1 group by 1,2),
m as (select station_id, sum(size)/count(*) as mass from z group by 1)
select e.station_id, epoch_us(e.ts) as ts_us,
  round(case when observed=1 then m.mass/z.size when humidity>=85 and slope<0 then 1.5 else 1.0 end,6)+0.0 as weight
from e left join z on z.station_id=e.station_id and z.ep=e.ep and e.observed=1 left join m on m.station_id=e.station_id""")
def onset_weights_light(spark, sf):
    """Negatives count more where it is humid and getting darker; without light it is not."""
    p = predictions(spark, sf, 30).withColumnRenamed("observed", "target").drop("rn")
    slope = F.when(F.col("light").isNotNull(), F.col("rn") % 7 - 3.0)
    h = readings(spark, sf).select(KEY, "ts", "humidity", slope.alias("light_slope_30m"))
    return L.onset_weights(p.join(h, [KEY, "ts"])).select(KEY, ts_us("ts"), rd("weight").alias("weight"))


@query("data_filter_counts", with_ctes(*SERIES) + ", l as (select *, " + ", ".join(
       f"{_future(h, 'rain_flag')} as rain_{h}m" for h in (5, 10, 30)) + """ from rseg)
select station_id, count(*) as total, sum(case when observation_gap_filled>0 then 1 else 0 end)::bigint as synthetic,
  count(rain_5m) as valid_5m, count(rain_10m) as valid_10m, count(rain_30m) as valid_30m,
  sum(case when observation_gap_filled=0 and rain_5m is not null and rain_10m is not null and rain_30m is not null then 1 else 0 end)::bigint as common
from l group by 1""")
def data_filter_counts(spark, sf):
    df = L.label_rows(readings(spark, sf).drop("rn"), (5, 10, 30), onset=False)
    return L.filter_counts(df, (5, 10, 30))
