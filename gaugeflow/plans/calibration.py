"""Bias, interval and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import daily as DS
from ..operators import drift as D
from ..operators.chunks import KEY
from ..operators.lineage import cut, fresh_path
from ..policy import BiasPolicy, IntervalPolicy
from .fixtures import NWP, READINGS, nwp_log, readings, with_ctes
from .matching import NEAREST
from .registry import query, rd, sql_rd, ts_us

BIAS, INTERVAL = BiasPolicy(min_samples=5), IntervalPolicy(min_samples=5)

PAIRS = """
pairs as (select station_id, issued_hour, valid_at, lead_hours, hour(issued_hour) as issue_hour, temp_forecast, temp - temp_forecast as error_c
          from near where k=1 and temp is not null)
"""
_BASE = (READINGS, NWP, NEAREST, PAIRS)


def _pairs(spark, sf):
    """Forecast errors, stored once: every fit and every look-up reads them."""
    return cut(C.error_pairs(nwp_log(spark, sf), readings(spark, sf), INTERVAL), "pairs")


@query("error_pairs", with_ctes(*_BASE) + """
select station_id, epoch_us(issued_hour) as issued_us, epoch_us(valid_at) as valid_us, lead_hours, cast(issue_hour as int) as issue_hour,
  round(error_c,6)+0.0 as error_c from pairs""")
def error_pairs(spark, sf):
    return _pairs(spark, sf).select(
        KEY, F.unix_micros("issued_hour").alias("issued_us"), F.unix_micros("valid_at").alias("valid_us"),
        "lead_hours", "issue_hour", rd("error_c").alias("error_c"))


@query("error_pairs_bias", with_ctes(*_BASE, """
bias as (
 select 'global' as scope, null::int as key, count(*) as n, median(error_c) as med from pairs
 union all select 'lead', lead_hours, count(*), median(error_c) from pairs where lead_hours<3 group by lead_hours
 union all select 'hour', issue_hour::int, count(*), median(error_c) from pairs where issue_hour%2=0 group by issue_hour)""") + """
select p.station_id, epoch_us(issued_hour) as issued_us, p.lead_hours, cast(issue_hour as int) as issue_hour,
  round(error_c - greatest(-6.0,least(6.0,round(coalesce(l.med,h.med,g.med),6))),5)+0.0 as error_c
from pairs p left join bias l on l.scope='lead' and l.key=p.lead_hours left join bias h on h.scope='hour' and h.key=p.issue_hour left join bias g on g.scope='global'""")
def error_pairs_bias(spark, sf):
    """Errors of the corrected forecast, where some leads and hours have a correction of their own."""
    model = C.fit_bias(_pairs(spark, sf), policy=BiasPolicy(min_samples=1))
    own = (F.col("scope") == C.GLOBAL) | ((F.col("scope") == C.LEAD) & (F.col("key") < 3)) | ((F.col("scope") == C.HOUR_SCOPE) & (F.col("key") % 2 == 0))
    out = C.error_pairs(nwp_log(spark, sf), readings(spark, sf), INTERVAL, bias=cut(model.filter(own), "bias"))
    return out.select(KEY, F.unix_micros("issued_hour").alias("issued_us"), "lead_hours", "issue_hour", rd("error_c", 5).alias("error_c"))


BIAS_SQL = """
bias as (
 select 'global' as scope, null::int as key, count(*) as n, median(error_c) as med, avg(error_c) as mean from pairs having count(*)>=5
 union all select 'lead', lead_hours, count(*), median(error_c), avg(error_c) from pairs group by lead_hours having count(*)>=5
 union all select 'hour', issue_hour::int, count(*), median(error_c), avg(error_c) from pairs group by issue_hour having count(*)>=5)
"""


@query("bias_fit", with_ctes(*_BASE, BIAS_SQL) + "select scope, key, n, round(med,5)+0.0 as median_c, round(round(mean,6),5)+0.0 as mean_c from bias")
def bias_fit(spark, sf):
    fit = C.fit_bias(_pairs(spark, sf), policy=BIAS)
    return fit.select("scope", "key", "n", rd("median_c", 5).alias("median_c"), rd("mean_c", 5).alias("mean_c"))


# A sample limit near the group sizes, so that leads, hours and the global scope all get used.
LIMIT = 164
THIN_SQL = BIAS_SQL.replace(">=5", f">={LIMIT}")


@query("bias_apply", with_ctes(*_BASE, THIN_SQL) + """
select n.station_id, epoch_us(n.issued_hour) as issued_us, n.lead_hours, round(n.temp_forecast,4)+0.0 as temp_raw,
  round(greatest(-6.0,least(6.0,coalesce(l.med,h.med,g.med,0.0))),4)+0.0 as temp_bias_correction,
  round(n.temp_forecast+greatest(-6.0,least(6.0,round(coalesce(l.med,h.med,g.med,0.0),6))),3)+0.0 as temp
from nwp_log n left join bias l on l.scope='lead' and l.key=n.lead_hours left join bias h on h.scope='hour' and h.key=hour(n.valid_at)
 left join bias g on g.scope='global'""")
def bias_apply(spark, sf):
    model = C.fit_bias(_pairs(spark, sf), policy=BiasPolicy(min_samples=LIMIT))
    timeline = nwp_log(spark, sf).withColumn("temp", F.col("temp_forecast"))
    out = C.apply_bias(timeline, model, F.hour("valid_at"))
    return out.select(
        KEY, F.unix_micros("issued_hour").alias("issued_us"), "lead_hours", rd("temp_raw", 4).alias("temp_raw"),
        rd("temp_bias_correction", 4).alias("temp_bias_correction"), rd("temp", 3).alias("temp"))


def _interval_sql(source: str) -> str:
    q = "quantile_cont(error_c,0.1) as lo, quantile_cont(error_c,0.9) as hi, median(error_c) as mid"
    return f"""
iv as (select station_id, 'global' as scope, null::int as key, count(*) as n, {q} from {source} group by 1 having count(*)>=5
 union all select station_id, 'lead', lead_hours, count(*), {q} from {source} group by station_id, lead_hours having count(*)>=5)
"""


@query("interval_fit", with_ctes(*_BASE, _interval_sql("pairs")) + """
select station_id, scope, key, n, round(lo,4)+0.0 as lower_error_c, round(hi,4)+0.0 as upper_error_c, round(mid,4)+0.0 as median_error_c from iv""")
def interval_fit(spark, sf):
    fit = C.fit_interval(_pairs(spark, sf), by=[KEY], policy=INTERVAL)
    return fit.select(KEY, "scope", "key", "n", *[rd(c, 4).alias(c) for c in ("lower_error_c", "upper_error_c", "median_error_c")])


STATION_LIMIT = 41


@query("interval_apply", with_ctes(*_BASE, _interval_sql("pairs").replace(">=5", f">={STATION_LIMIT}")) + """
select n.station_id, epoch_us(n.issued_hour) as issued_us, n.lead_hours,
 round(n.temp_forecast+round(case when l.n is not null then l.lo else g.lo end,4),2)+0.0 as interval_lower,
 round(n.temp_forecast+round(case when l.n is not null then l.hi else g.hi end,4),2)+0.0 as interval_upper,
 coalesce(l.n,g.n) as interval_samples
from nwp_log n left join iv l on l.station_id=n.station_id and l.scope='lead' and l.key=n.lead_hours
 left join iv g on g.station_id=n.station_id and g.scope='global'""")
def interval_apply(spark, sf):
    model = C.fit_interval(_pairs(spark, sf), by=[KEY], policy=IntervalPolicy(min_samples=STATION_LIMIT))
    out = C.apply_interval(nwp_log(spark, sf).withColumn("temp", F.col("temp_forecast")), model, by=[KEY])
    return out.select(
        KEY, F.unix_micros("issued_hour").alias("issued_us"), "lead_hours",
        rd("interval_lower", 2).alias("interval_lower"), rd("interval_upper", 2).alias("interval_upper"), "interval_samples")


_HOLD = """
num as (select *, row_number() over (partition by station_id order by valid_at, issued_hour) as i, count(*) over (partition by station_id) as total from pairs),
hs as (select *, i > greatest(1, least(total-1, floor(total*0.8::double))) as holdout from num),
early as (select * from hs where not holdout)
"""


@query("interval_holdout", with_ctes(*_BASE, _HOLD, _interval_sql("early")) + """
select h.station_id, count(*) as paired_rows, count(coalesce(l.lo,g.lo)) as interval_rows,
 round(avg(cast(error_c>=round(coalesce(l.lo,g.lo),4) and error_c<=round(coalesce(l.hi,g.hi),4) as int)),6)+0.0 as coverage,
 round(avg(round(coalesce(l.hi,g.hi),4)-round(coalesce(l.lo,g.lo),4)),4)+0.0 as mean_width_c
from hs h left join iv l on l.station_id=h.station_id and l.scope='lead' and l.key=h.lead_hours
 left join iv g on g.station_id=h.station_id and g.scope='global' where h.holdout group by 1""")
def interval_holdout(spark, sf):
    split = C.holdout_split(_pairs(spark, sf), [KEY], ["valid_at", "issued_hour"], INTERVAL)
    _, report = C.evaluate_interval(split, [KEY], INTERVAL)
    return report.select(KEY, "paired_rows", "interval_rows", rd("coverage").alias("coverage"), rd("mean_width_c", 4).alias("mean_width_c"))


FEATURES = ("temp", "humidity", "pressure", "rain_flag", "light", "wind_speed")
_LONG = ("long as (" + " union all ".join(f"select '{f}' as feature, ts, {f}::double as value from readings" for f in FEATURES) + ")",
         f"cut as (select timestamp '2024-01-02 06:00:00' as cut_ts)")
_BASELINE = """
old as (select feature, value from long, cut where ts<cut_ts and value is not null),
new as (select feature, value from long, cut where ts>=cut_ts and value is not null),
qq as (select feature, count(*) as n, avg(value) as mean, stddev_pop(value) as std, list_sort(list_distinct(quantile_cont(value,
   [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) as u from old group by 1),
ed as (select feature, n, mean, std, case when len(u)>=2 then u else [u[1]-0.5,u[1]+0.5] end as edges from qq),
bn as (select feature, n, mean, std, edges, unnest(range(1,len(edges))) as b from ed),
hb as (select bn.feature, any_value(bn.n) as n, any_value(mean) as mean, any_value(std) as std, any_value(edges) as edges, b,
   count(o.value) filter (where (b=1 or o.value>=edges[b]) and (b=len(edges)-1 or o.value<edges[b+1])) as c from bn join old o on o.feature=bn.feature group by bn.feature, b),
ps as (select *, (c+1e-6)/(sum(c) over (partition by feature)+1e-6*count(*) over (partition by feature)) as p from hb)
"""


@query("drift_baseline", with_ctes(READINGS, *_LONG, _BASELINE) + """
select feature, n, round(mean,5)+0.0 as mean, round(std,5)+0.0 as std, cast(b-1 as int) as bin, round(edges[b],5)+0.0 as low, round(edges[b+1],5)+0.0 as high,
 round(p,6)+0.0 as proportion from ps""")
def drift_baseline(spark, sf):
    old = readings(spark, sf).filter("ts < timestamp'2024-01-02 06:00:00'")
    base = D.baseline(old, FEATURES)
    rows = base.select("feature", "n", "mean", "std", "edges", F.posexplode("proportions").alias("bin", "p"))
    return rows.select(
        "feature", "n", rd("mean", 5).alias("mean"), rd("std", 5).alias("std"), "bin",
        rd(F.element_at("edges", F.col("bin") + 1), 5).alias("low"), rd(F.element_at("edges", F.col("bin") + 2), 5).alias("high"),
        rd("p").alias("proportion"))


_COMPARE = """
hn as (select ps.feature, b, any_value(ps.n) as n0, any_value(mean) as mean, any_value(std) as std, any_value(p) as p,
   count(o.value) filter (where (b=1 or o.value>=edges[b]) and (b=len(edges)-1 or o.value<edges[b+1])) as c from ps left join new o on o.feature=ps.feature group by ps.feature, b),
pn as (select *, greatest(p/sum(p) over (partition by feature),1e-6) as e, greatest(c/nullif(sum(c) over (partition by feature),0),1e-6) as a from hn),
mn as (select feature, count(*) as n, avg(value) as m from new group by 1),
dr as (select pn.feature, coalesce(any_value(mn.n),0) as n, case when any_value(mn.n) is not null then sum((a-e)*ln(a/e)) end as psi, (any_value(m)-any_value(mean))/greatest(any_value(std),1e-6) as shift
   from pn left join mn on mn.feature=pn.feature group by 1)
"""


def _drift(spark, sf):
    r = readings(spark, sf)
    base = D.baseline(r.filter("ts < timestamp'2024-01-02 06:00:00'"), FEATURES)
    return D.compare(r.filter("ts >= timestamp'2024-01-02 06:00:00'"), base, FEATURES)


@query("drift_compare", with_ctes(READINGS, *_LONG, _BASELINE, _COMPARE) + """
select feature, n, round(psi,5)+0.0 as psi, round(shift,5)+0.0 as mean_shift, case when n=0 then 'missing' when psi>=0.25 then 'high' when psi>=0.1 then 'watch' else 'ok' end as status from dr""")
def drift_compare(spark, sf):
    return _drift(spark, sf).select("feature", "n", rd("psi", 5).alias("psi"), rd("mean_shift", 5).alias("mean_shift"), "status")


@query("drift_summary", with_ctes(READINGS, *_LONG, _BASELINE, _COMPARE) + """
select round(avg(psi),5)+0.0 as mean_psi, count(*) as n_features, coalesce(string_agg(case when psi>=0.25 then feature end, ',' order by feature),'') as high from dr""")
def drift_summary(spark, sf):
    return D.summary(_drift(spark, sf)).select(
        rd("mean_psi", 5).alias("mean_psi"), "n_features", F.array_join("high_drift_features", ",").alias("high"))


# ---- the same models from states of days -----------------------------------------------
def _by_day(spark, rows, date, state, name):
    """Stored in two steps, the newest date last, as a daily job would."""
    folder = fresh_path(spark, name)
    rows = cut(rows.withColumn("_d", date), name)
    newest = rows.agg(F.max("_d")).scalar()
    for part in (rows.filter(F.col("_d") < newest), rows.filter(F.col("_d") == newest)):
        DS.add_days(part, folder, F.col("_d"), state)
    return folder


@query("daywise_bias", with_ctes(*_BASE, BIAS_SQL) + "select scope, key, n, round(med,5)+0.0 as median_c, round(round(mean,6),5)+0.0 as mean_c from bias")
def daywise_bias(spark, sf):
    folder = _by_day(spark, _pairs(spark, sf), DS.day_of("valid_at"), lambda df, by: C.error_state(df, by=by), "bias-states")
    fit = C.bias_of_states(DS.states(spark, folder), policy=BIAS)
    return fit.select("scope", "key", "n", rd("median_c", 5).alias("median_c"), rd("mean_c", 5).alias("mean_c"))


@query("daywise_interval", with_ctes(*_BASE, _interval_sql("pairs")) + """
select station_id, scope, key, n, round(lo,4)+0.0 as lower_error_c, round(hi,4)+0.0 as upper_error_c, round(mid,4)+0.0 as median_error_c from iv""")
def daywise_interval(spark, sf):
    folder = _by_day(spark, _pairs(spark, sf), DS.day_of("valid_at"), lambda df, by: C.error_state(df, by=[*by, KEY]), "interval-states")
    fit = C.interval_of_states(DS.states(spark, folder), by=[KEY], policy=INTERVAL)
    return fit.select(KEY, "scope", "key", "n", *[rd(c, 4).alias(c) for c in ("lower_error_c", "upper_error_c", "median_error_c")])


def _at_midnight(sql: str) -> str:
    return sql.replace("2024-01-02 06:00:00", "2024-01-02 00:00:00")


@query("daywise_drift", _at_midnight(with_ctes(READINGS, *_LONG, _BASELINE, _COMPARE)) + """
select feature, n, round(psi,5)+0.0 as psi, round(shift,5)+0.0 as mean_shift, case when n=0 then 'missing' when psi>=0.25 then 'high' when psi>=0.1 then 'watch' else 'ok' end as status from dr""")
def daywise_drift(spark, sf):
    folder = _by_day(spark, readings(spark, sf), DS.day_of("ts"), lambda df, by: D.value_state(df, FEATURES, by), "drift-states")
    base = D.baseline_of_values(D.merged_values(DS.states(spark, folder, before="2024-01-02")))
    recent = D.merged_values(DS.states(spark, folder, first="2024-01-02"))
    return D.compare_values(recent, base).select("feature", "n", rd("psi", 5).alias("psi"), rd("mean_shift", 5).alias("mean_shift"), "status")
