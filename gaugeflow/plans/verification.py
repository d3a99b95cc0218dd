"""Verification of labelled probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coherence as C
from ..operators import labels as L
from ..operators import metrics as M
from ..operators.chunks import KEY
from .fixtures import KEPT, READINGS, predictions, predictions_sql, readings, with_ctes
from .registry import query, rd, sql_rd, ts_us

BASE10 = (READINGS, KEPT, predictions_sql(10))
ALL3 = (READINGS, KEPT, predictions_sql(5), predictions_sql(10), predictions_sql(30))


def _all(spark, sf):
    return predictions(spark, sf, 5, 10, 30)


_UNION = "allp as (select * from pred5 union all select * from pred10 union all select * from pred30)"
_RATES = """round(case when tp+fp>0 then tp/(tp+fp) else 0 end,6)+0.0 as precision, round(case when tp+fn>0 then tp/(tp+fn) else 0 end,6)+0.0 as recall,
 round(case when 2*tp+fp+fn>0 and tp>0 then 2*tp/(2*tp+fp+fn) else 0 end,6)+0.0 as f1,
 round(case when fp+tn>0 then fp/(fp+tn) else 0 end,6)+0.0 as false_alarm_rate,
 round(case when tp+fp>0 then fp/(tp+fp) else 0 end,6)+0.0 as false_alarm_ratio"""
_RATE_COLS = ("precision", "recall", "f1", "false_alarm_rate", "false_alarm_ratio")


def _counts_sql(threshold: str) -> str:
    return (f"count(*) filter (where probability>={threshold} and observed=1) as tp, count(*) filter (where probability>={threshold} and observed=0) as fp,"
            f"count(*) filter (where probability<{threshold} and observed=1) as fn, count(*) filter (where probability<{threshold} and observed=0) as tn")


@query("confusion", with_ctes(*ALL3, _UNION) + f"select horizon, tp, fp, fn, tn, {_RATES} from (select horizon, {_counts_sql('0.37')} from allp group by 1)")
def confusion(spark, sf):
    return M.confusion(_all(spark, sf), 0.37, ["horizon"]).select(
        "horizon", "tp", "fp", "fn", "tn", *[rd(c).alias(c) for c in _RATE_COLS])


_SWEEP = f"""sw as (select horizon, t, {_counts_sql('t')} from allp cross join (select (unnest(range(1,100))/100.0)::double as t) group by 1,2)"""


@query("threshold_sweep", with_ctes(*ALL3, _UNION, _SWEEP) + f"select horizon, round(t,2)+0.0 as threshold, tp, fp, fn, tn, {_RATES} from sw")
def threshold_sweep(spark, sf):
    return M.sweep(_all(spark, sf), ["horizon"]).select(
        "horizon", rd("threshold", 2).alias("threshold"), "tp", "fp", "fn", "tn", *[rd(c).alias(c) for c in _RATE_COLS])


@query("threshold_best", with_ctes(*ALL3, _UNION, _SWEEP) + f""", r as (select horizon, t, tp, fp, fn, tn, {_RATES} from sw)
select horizon, round(t,2)+0.0 as threshold, f1, recall from
 (select *, row_number() over (partition by horizon order by f1 desc, recall desc, false_alarm_rate, t) as k from r) where k=1""")
def threshold_best(spark, sf):
    best = M.best_threshold(M.sweep(_all(spark, sf), ["horizon"]), ["horizon"])
    return best.select("horizon", rd("threshold", 2).alias("threshold"), rd("f1").alias("f1"), rd("recall").alias("recall"))


@query("average_precision", with_ctes(*ALL3, _UNION) + """
, sc as (select station_id, horizon, probability as p, sum(observed) as pos, count(*) as n from allp group by 1,2,3),
c as (select *, sum(pos) over w as tp, sum(n) over w as al from sc window w as (partition by station_id, horizon order by p desc))
select station_id, horizon, sum(pos)::bigint as positives, round(sum(pos*tp/al)/nullif(sum(pos),0),6)+0.0 as average_precision from c group by 1,2""")
def average_precision(spark, sf):
    return M.average_precision(_all(spark, sf), [KEY, "horizon"]).select(
        KEY, "horizon", "positives", rd("average_precision").alias("average_precision"))


@query("reliability", with_ctes(*ALL3, _UNION) + """
select horizon, cast(least(floor(probability*10),9) as int) as bin, count(*) as n, round(avg(probability),6)+0.0 as mean_predicted,
 round(avg(observed),6)+0.0 as mean_observed from allp group by 1,2""")
def reliability(spark, sf):
    return M.reliability(_all(spark, sf), ["horizon"]).select(
        "horizon", "bin", "n", rd("mean_predicted").alias("mean_predicted"), rd("mean_observed").alias("mean_observed"))


_PARTS = """
o as (select *, row_number() over (partition by station_id order by ts)-1 as i, count(*) over (partition by station_id) as n from pred30),
p as (select *, case when i<floor(n*0.6::double) then 1 when i<floor(n*0.7::double) then 2 when i<floor(n*0.8::double) then 3 else 4 end as part from o),
s as (select station_id, part, min(epoch_us(ts)) as start_us from p group by 1,2),
parts as (select p.station_id, p.ts, p.rain_flag, p.observed, p.probability, p.part from p left join s on s.station_id=p.station_id and s.part=p.part+1
where s.start_us is null or epoch_us(p.ts)+1830000000 < s.start_us),
tr as (select station_id, hour(ts) as h, avg(observed) as rate from parts where part=1 group by 1,2),
ov as (select station_id, avg(observed) as rate from parts where part=1 group by 1)
"""


@query("brier_skill", with_ctes(READINGS, KEPT, predictions_sql(30), _PARTS) + """
select station_id, n, positive_rows, round(b,6)+0.0 as brier, round(c,6)+0.0 as climatology_brier, round(q,6)+0.0 as persistence_brier,
 round(case when c>0 then 1-b/c end,5)+0.0 as brier_skill from (
 select t.station_id, count(*) as n, sum(observed)::bigint as positive_rows, avg((probability-observed)**2) as b,
  avg((coalesce(tr.rate,ov.rate)-observed)**2) as c, avg(((case when rain_flag>0.1 then 1 else 0 end)-observed)**2) as q
 from parts t left join tr on tr.station_id=t.station_id and tr.h=hour(t.ts) left join ov on ov.station_id=t.station_id
 where part=4 group by 1)""")
def brier_skill(spark, sf):
    df = L.split(predictions(spark, sf, 30), 30)
    df = M.with_hourly_climatology(df, F.col("part") == "train", [KEY]).withColumn("persistence", M.persistence())
    out = M.brier(df.filter("part = 'test'"), [KEY], extra={"climatology_brier": "climatology", "persistence_brier": "persistence"})
    out = out.withColumn("brier_skill", M.skill("brier", "climatology_brier"))
    return out.select(KEY, "n", "positive_rows", *[rd(c).alias(c) for c in ("brier", "climatology_brier", "persistence_brier")],
                      rd("brier_skill", 5).alias("brier_skill"))


_BLEND = """
bl as (select *, case when rain_flag>0.1 then 1.0 else 0.0 end::double as q from pred10),
w0 as (select station_id, greatest(0.0,least(1.0,sum((observed-q)*(probability-q))/sum((probability-q)**2))) as w, sum((probability-q)**2) as dd from bl group by 1),
w1 as (select bl.station_id, count(*) as n, any_value(w0.w) as w, any_value(dd) as dd, avg((q+w0.w*(probability-q)-observed)**2) as be, avg((probability-observed)**2) as me
  from bl join w0 on w0.station_id=bl.station_id group by 1),
wt as (select station_id, n, case when dd<=2.220446049250313e-16 then 1.0 when be>=me-1e-12 then 1.0 else w end as weight from w1)
"""


@query("blend_weight", with_ctes(*BASE10, _BLEND) + "select station_id, n, round(weight,6)+0.0 as weight from wt")
def blend_weight(spark, sf):
    df = predictions(spark, sf, 10).withColumn("persistence", M.persistence())
    return M.blend_weight(df, [KEY]).select(KEY, "n", rd("weight").alias("weight"))


@query("blend_apply", with_ctes(*BASE10, _BLEND) + """
select bl.station_id, epoch_us(ts) as ts_us, round(weight*probability+(1-weight)*q,6)+0.0 as blended from bl join wt on wt.station_id=bl.station_id""")
def blend_apply(spark, sf):
    df = predictions(spark, sf, 10).withColumn("persistence", M.persistence())
    df = df.join(M.blend_weight(df, [KEY]).drop("n"), KEY)
    return df.select(KEY, ts_us("ts"), rd(M.blended(F.col("probability"), F.col("persistence"), F.col("weight"))).alias("blended"))


# Isotonic regression by explicit enumeration of means over all index ranges.
_COH = """
v as (select station_id, epoch_us(ts) as ts_us, [((rn*13)%101)/101.0::double, ((rn*29)%101)/101.0::double, ((rn*47)%101)/101.0::double] as p from readings),
ix as (select i, j, k from range(1,4) a(i), range(1,4) b(j), range(1,4) c(k) where j<=i and k>=i),
m as (select station_id, ts_us, p, i, j, min(list_sum(p[j:k])/(k-j+1)) as lo from v, ix group by all),
x as (select station_id, ts_us, p, i, max(lo) as q from m group by all)
"""


@query("coherence", with_ctes(READINGS, _COH) + """
select station_id, ts_us, round(max(case when i=1 then q end),6)+0.0 as p_5m, round(max(case when i=2 then q end),6)+0.0 as p_10m,
 round(max(case when i=3 then q end),6)+0.0 as p_30m from x group by 1,2""")
def coherence(spark, sf):
    df = readings(spark, sf).select(
        KEY, ts_us("ts"), *[((F.col("rn") * k) % 101 / 101.0).alias(f"p_{h}m") for h, k in ((5, 13), (10, 29), (30, 47))])
    return C.coherent(df, (5, 10, 30)).select(KEY, "ts_us", *[rd(f"p_{h}m").alias(f"p_{h}m") for h in (5, 10, 30)])


@query("common_times", with_ctes(*ALL3, _UNION) + """
select horizon, count(*) as n, epoch_us(max(ts)) as last_us from allp
where (station_id, ts) in (select (station_id, ts) from pred5 intersect select (station_id, ts) from pred10 intersect select (station_id, ts) from pred30) group by 1""")
def common_times(spark, sf):
    df = M.common_times(_all(spark, sf), 3, [KEY, "ts"])
    return df.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("compare_common", with_ctes(*ALL3) + """
select station_id, n, round(rb,6)+0.0 as reference_brier, round(cb,6)+0.0 as candidate_brier, round(100*(rb-cb)/rb,4)+0.0 as brier_improvement_pct from (
select a.station_id, count(*) as n, avg((b.probability-a.observed)**2) as rb, avg((a.probability-a.observed)**2) as cb
from pred10 a join pred30 b on b.station_id=a.station_id and b.ts=a.ts group by 1)""")
def compare_common(spark, sf):
    out = M.compare_on_common(predictions(spark, sf, 10), predictions(spark, sf, 30), [KEY, "ts"], [KEY])
    return out.select(KEY, "n", rd("reference_brier").alias("reference_brier"), rd("candidate_brier").alias("candidate_brier"),
                      rd("brier_improvement_pct", 4).alias("brier_improvement_pct"))


# Joint evaluation: isotonic projection per row, thresholds on validation, confusion on test.
_JOINT = f"""
cm as (select station_id, ts, any_value(rn) as rn, [max(probability) filter (where horizon=5)+0.00313, max(probability) filter (where horizon=10)+0.00313, max(probability) filter (where horizon=30)+0.00313] as p,
  [max(observed) filter (where horizon=5), max(observed) filter (where horizon=10), max(observed) filter (where horizon=30)] as y from allp group by 1,2 having count(*)=3),
ix as (select i, j, k from range(1,4) a(i), range(1,4) b(j), range(1,4) c(k) where j<=i and k>=i),
lo as (select station_id, ts, i, j, min(list_sum(p[j:k])/(k-j+1)) as lo from cm, ix group by all),
qq as (select station_id, ts, i, max(lo) as q from lo group by all),
jt as (select cm.station_id, cm.ts, [5,10,30][i] as horizon, q as probability, y[i] as observed, case when rn%2=0 then 'validation' else 'test' end as part from cm join qq using (station_id, ts)),
sv as (select horizon, t, {_counts_sql('t')} from jt cross join (select (unnest(range(1,100))/100.0)::double as t) where part='validation' group by 1,2),
rv as (select horizon, t, {_RATES} from sv),
ch as (select horizon, t from (select *, row_number() over (partition by horizon order by f1 desc, recall desc, false_alarm_rate, t) as k from rv) where k=1)
"""


@query("joint_thresholds", with_ctes(*ALL3, _UNION, _JOINT) + f"""
select jt.horizon, round(t,2)+0.0 as threshold, {_counts_sql('t')} from jt join ch on ch.horizon=jt.horizon where part='test' group by 1,2""")
def joint_thresholds(spark, sf):
    from ..operators.learning import joint_thresholds as joint

    rows = M.common_times(_all(spark, sf), 3, [KEY, "ts"]).withColumns({
        "part": F.when(F.col("rn") % 2 == 0, "validation").otherwise("test"), "probability": F.col("probability") + 0.00313})
    wide, chosen = joint({h: rows.filter(F.col("horizon") == h).select(KEY, "ts", "part", "probability", "observed") for h in (5, 10, 30)})
    out = None
    for h, t in chosen.items():
        test = wide.filter("part = 'test'").select(F.col(f"p_{h}m").alias("probability"), F.col(f"observed_{h}m").alias("observed"))
        one = M.confusion(test, t).select(F.lit(h).alias("horizon"), F.lit(round(t, 2)).alias("threshold"), "tp", "fp", "fn", "tn")
        out = one if out is None else out.unionByName(one)
    return out


# Rain within the hour before, from the time alone, so that both engines have it.
_BEFORE = "case when rain_flag>0.1 or (epoch_us(t.ts)//1000000)%3=0 then 0.4 else 0.0 end"


@query("holdout_metrics", with_ctes(READINGS, KEPT, predictions_sql(30), _PARTS) + f"""
, k as (select t.*, coalesce(tr.rate,ov.rate) as climate, case when rain_flag>0.1 then 1.0 else 0.0 end as persist, {_BEFORE} as before
  from parts t left join tr on tr.station_id=t.station_id and tr.h=hour(t.ts) left join ov on ov.station_id=t.station_id where part=4),
c as (select *, 'all' as cohort from k union all select *, 'dry_now' from k where rain_flag<=0.1 union all select *, 'dry_60m' from k where rain_flag<=0.1 and before<=0.1),
g as (select station_id, cohort, count(*) as n, sum(observed)::bigint as positive_rows, avg((probability-observed)**2) as b, avg((climate-observed)**2) as c, avg((persist-observed)**2) as q,
  count(*) filter (where probability>=0.5 and observed=1) as tp, count(*) filter (where probability>=0.5 and observed=0) as fp, count(*) filter (where probability<0.5 and observed=1) as fn, count(*) filter (where probability<0.5 and observed=0) as tn from c group by 1,2),
sc as (select station_id, cohort, probability as p, sum(observed) as pos, count(*) as n from c group by 1,2,3),
cu as (select *, sum(pos) over w as tp, sum(n) over w as al from sc window w as (partition by station_id, cohort order by p desc)),
ap as (select station_id, cohort, sum(pos*tp/al)/nullif(sum(pos),0) as ap from cu group by 1,2)
select station_id, cohort, n, positive_rows, round(b,6)+0.0 as brier, round(ap,6)+0.0 as average_precision, round(c,6)+0.0 as climatology_brier, round(q,6)+0.0 as persistence_brier,
 round(case when c>0 then 1-b/c end,5)+0.0 as brier_skill, {_RATES} from g join ap using (station_id, cohort)""")
def holdout_metrics(spark, sf):
    """The report on a holdout, for fixed probabilities."""
    before = F.when((F.col("rain_flag") > 0.1) | (F.floor(F.unix_micros("ts") / 1e6) % 3 == 0), 0.4).otherwise(0.0)
    parts = L.split(predictions(spark, sf, 30), 30).withColumn("rain_last_60m", before)
    out = M.holdout_metrics(parts, 0.5, [KEY])
    return out.select(
        KEY, "cohort", "n", "positive_rows", *[rd(c).alias(c) for c in ("brier", "average_precision", "climatology_brier", "persistence_brier")], rd("brier_skill", 5).alias("brier_skill"),
        *[rd(c).alias(c) for c in _RATE_COLS])
