"""Rain events, alert policy and event-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import events as E
from ..operators import rain_events as R
from ..operators.chunks import KEY
from ..policy import EPISODE_THRESHOLDS
from .fixtures import KEPT, READINGS, predictions, predictions_sql, readings, with_ctes
from .registry import query, rd, ts_us

# Step-by-step session machine over every reading, as a recursive walk.
MACHINE = """
rs as (select station_id, ts, rain_flag>0.1 as wet, row_number() over (partition by station_id order by ts) as i,
   coalesce(epoch_us(ts)-epoch_us(lag(ts) over (partition by station_id order by ts))>150000000, true) as brk from readings),
st as (select station_id, i, ts, wet as active, case when wet then epoch_us(ts) end as start_us, 0 as dry, null::bigint as dry_us,
   null::bigint as done_start, null::bigint as done_stop, false as cut, null::bigint as cut_start from rs where i=1
 union all
 select station_id, i, ts, active2 and not fin, case when active2 and not fin then start2 end, case when fin then 0 else dry2 end,
   case when fin then null else dry_us2 end, case when fin then start2 end, case when fin then dry_us2 end, cut2, cut_start2
 from (select *, active2 and not wet and dry2>=10 as fin from (
   select rs.station_id, rs.i, rs.ts, rs.wet,
     (st.active and not rs.brk) or rs.wet as active2,
     case when st.active and not rs.brk then st.start_us when rs.wet then epoch_us(rs.ts) end as start2,
     case when rs.wet then 0 when st.active and not rs.brk then st.dry+1 else 0 end as dry2,
     case when rs.wet then null when st.active and not rs.brk then coalesce(st.dry_us, epoch_us(rs.ts)) end as dry_us2,
     rs.brk and st.active as cut2, case when rs.brk and st.active then st.start_us end as cut_start2
   from st join rs on rs.station_id=st.station_id and rs.i=st.i+1))),
fin as (select station_id, done_start as start_us, done_stop as stop_us from st where done_start is not null
  union all select station_id, cut_start, null from st where cut
  union all select station_id, start_us, null from (select *, row_number() over (partition by station_id order by i desc) as k from st) where k=1 and active)
"""


def _recursive(*ctes):
    return with_ctes(*ctes).replace("with ", "with recursive ", 1)


@query("rain_events", _recursive(READINGS, MACHINE) + """
select station_id, row_number() over (partition by station_id order by start_us) as event_no, start_us, stop_us, stop_us is not null as complete,
 round((stop_us-start_us)/60e6,2)+0.0 as duration_minutes from fin""")
def rain_events(spark, sf):
    return R.rain_events(readings(spark, sf)).select(
        KEY, "event_no", "start_us", "stop_us", "complete", rd("duration_minutes", 2).alias("duration_minutes"))


# Histories are cut at four different times per station, so that several statuses occur.
_CUTS = """
cuts as (select station_id, case station_id when 0 then (select max(ts) from readings where station_id=0 and rain_flag>0.1)
   when 1 then (select max(ts)+interval 3 minutes from readings where station_id=1 and rain_flag>0.1)
   else max(ts) end as upto from readings group by 1),
cutr as (select r.* from readings r join cuts c on c.station_id=r.station_id and r.ts<=c.upto)
"""


def _cut_history(spark, sf):
    r = readings(spark, sf)
    wet = F.max(F.when(F.col("rain_flag") > 0.1, F.col("ts")))
    upto = r.groupBy(KEY).agg(wet.alias("w"), F.max("ts").alias("m")).select(
        KEY, F.when(F.col(KEY) == 0, F.col("w")).when(F.col(KEY) == 1, F.expr("w + interval 3 minutes")).otherwise(F.col("m")).alias("upto"))
    return r.join(upto, KEY).filter("ts <= upto").drop("upto")


_STOP = """
dur as (select station_id, count(*) as n, quantile_cont(round((stop_us-start_us)/60e6,2),[0.2,0.5,0.8]) as q from fin where stop_us is not null group by 1),
cen as (select station_id, count(*) as c from fin where stop_us is null group by 1),
lst as (select station_id, max(ts) as latest, arg_max(wet,ts) as wet, max(case when brk then epoch_us(ts) end) as seg_us from rs group by 1),
opn as (select f.station_id, max(f.start_us) as start_us from fin f join lst on lst.station_id=f.station_id where f.stop_us is null and f.start_us>=lst.seg_us group by 1),
lad as (select l.*, coalesce(d.n,0) as n, coalesce(c.c,0) as c, q, o.start_us, greatest(0,(epoch_us(latest)-o.start_us)/60e6) as el,
  case when false then '' when not wet and o.start_us is not null then 'stop_not_confirmed' when not wet or o.start_us is null then 'not_raining'
   when coalesce(d.n,0)<3 then 'insufficient_completed_events' else 'experimental' end as status
  from lst l left join dur d on d.station_id=l.station_id left join cen c on c.station_id=l.station_id left join opn o on o.station_id=l.station_id)
"""


@query("rain_stop", _recursive(READINGS, _CUTS, MACHINE.replace("from readings", "from cutr"), _STOP) + """
select station_id, epoch_us(latest) as latest_us, case when station_id=3 then 'latest_observation_stale' else status end as status, n as completed_events, c as censored_events,
 case when station_id<>3 and status in ('experimental','insufficient_completed_events') then round(el,2)+0.0 end as elapsed_minutes,
 case when station_id<>3 and status='experimental' then round(greatest(0,q[1]-el),1)+0.0 end as remaining_lower,
 case when station_id<>3 and status='experimental' then round(greatest(0,q[2]-el),1)+0.0 end as remaining_median,
 case when station_id<>3 and status='experimental' then round(greatest(greatest(0,q[2]-el),q[3]-el),1)+0.0 end as remaining_upper,
 case when station_id<>3 and status='experimental' then round(q[2],1)+0.0 end as p50 from lad""")
def rain_stop(spark, sf):
    """``now`` is the newest reading of each station; station 3 is judged three minutes later."""
    h = _cut_history(spark, sf)
    latest = h.groupBy(KEY).agg(F.max("ts").alias("_l"))
    df = R.rain_stop_at(h, latest.select(KEY, F.when(F.col(KEY) == 3, F.expr("_l + interval 3 minutes")).otherwise(F.col("_l")).alias("now")))
    return df.select(
        KEY, F.unix_micros("latest").alias("latest_us"), "status", "completed_events", "censored_events",
        rd("elapsed_minutes", 2).alias("elapsed_minutes"),
        *[rd(c, 1).alias(c) for c in ("remaining_lower", "remaining_median", "remaining_upper", "p50")])


_SIG = """
sg as (select station_id, ts, rain_flag, ((rn*13)%101)/101.0::double as p5, ((rn*29)%101)/101.0::double as p10, ((rn*47)%101)/101.0::double as p30 from readings),
s1 as (select *, rain_flag>0.1 as raining, (p5>=0.6 and rain_flag<=0.1)::int as a5, (p10>=0.5 and rain_flag<=0.1)::int as a10, (p30>=0.4 and rain_flag<=0.1)::int as a30 from sg),
s2 as (select *, a5+a10+a30 as cnt, a5+a10+a30>=2 as cons from s1),
sig as (select *, cnt>0 and cons as any_alert, case when not cons then null when a5=1 then '5m' when a10=1 then '10m' when a30=1 then '30m' end as next_horizon from s2)
"""
_THRESHOLDS = {5: 0.6, 10: 0.5, 30: 0.4}


def _signals(spark, sf):
    df = readings(spark, sf).select(
        KEY, "ts", "rn", "rain_flag", *[((F.col("rn") * k) % 101 / 101.0).alias(f"p_{h}m") for h, k in ((5, 13), (10, 29), (30, 47))])
    return A.signals(df, (5, 10, 30), _THRESHOLDS)


@query("alert_signal", with_ctes(READINGS, _SIG) + """
select station_id, epoch_us(ts) as ts_us, cnt as signal_count, cons as consensus, any_alert, next_horizon,
 case when any_alert then 'Rain alert in '||next_horizon when raining and cnt=0 then 'Raining now; no advance rain alert' else 'No rain alert' end as alert_message,
 raining and p5>=0.6 as suppressed_by_rain_5m from sig""")
def alert_signal(spark, sf):
    return _signals(spark, sf).select(
        KEY, ts_us("ts"), "signal_count", "consensus", "any_alert", "next_horizon", "alert_message", "suppressed_by_rain_5m")


_ONSET = _SIG.replace("rain_flag<=0.1)::int", "rain_flag<=0.1 and before<=0.1)::int").replace("from readings)", ", case when rn%4=0 then null when (rn//7)%3=0 then 0.4 else 0.05 end::double as before from readings)")


@query("alert_signal_onset", with_ctes(READINGS, _ONSET) + """
select station_id, epoch_us(ts) as ts_us, coalesce(cnt,0) as signal_count, coalesce(cons,false) as consensus, coalesce(any_alert,false) as any_alert, case when coalesce(cons,false) then next_horizon end as next_horizon,
 not raining and p5>=0.6 and not coalesce(before<=0.1,false) as suppressed_by_antecedent_5m, raining and p5>=0.6 as suppressed_by_rain_5m
from (select * replace (coalesce(a5,0) as a5, coalesce(a10,0) as a10, coalesce(a30,0) as a30) from sig)""")
def alert_signal_onset(spark, sf):
    """Onset models alert only where it is dry now and was over the hour before; an unknown past counts as wet."""
    rn = F.col("rn")
    before = F.when(rn % 4 == 0, F.lit(None)).when(F.floor(rn / 7) % 3 == 0, 0.4).otherwise(0.05)
    df = readings(spark, sf).select(
        KEY, "ts", "rain_flag", before.alias("rain_last_60m"), *[((rn * k) % 101 / 101.0).alias(f"p_{h}m") for h, k in ((5, 13), (10, 29), (30, 47))])
    out = A.signals(df, (5, 10, 30), _THRESHOLDS, onset_model=True)
    dry = F.col("rain_flag") <= 0.1
    return out.select(
        KEY, ts_us("ts"), "signal_count", "consensus", "any_alert", F.when(F.col("consensus"), F.col("next_horizon")).alias("next_horizon"),
        (dry & F.col("suppressed_by_antecedent_5m")).alias("suppressed_by_antecedent_5m"), "suppressed_by_rain_5m")


# The stateful policy, one poll after the other.
_POLICY = """
po as (select station_id, ts, rain_flag>0.1 as wet, any_alert, (hash_r%5<4) as radar, row_number() over (partition by station_id order by ts) as i
  from (select s.*, (epoch_us(s.ts)//60000000)%997 as hash_r from sig s)),
al as (
 select station_id, i, ts, wet as rain, false as was_rain, case when wet then 0 else 1 end as dry,
   (any_alert and not wet)::int as mc, 0 as was_mc, (radar and not wet)::int as rc, 0 as was_rc from po where i=1
 union all
 select station_id, i, ts, rain, was_rain, dry, case when any_alert and not rain then was_mc+1 else 0 end, was_mc,
   case when radar and not rain then was_rc+1 else 0 end, was_rc from (
  select *, wet or (was_rain and dry<3) as rain from (
   select po.station_id, po.i, po.ts, po.wet, po.any_alert, po.radar, al.rain as was_rain, al.mc as was_mc, al.rc as was_rc,
    case when po.wet then 0 else al.dry+1 end as dry
   from al join po on po.station_id=al.station_id and po.i=al.i+1))),
nt as (
 select station_id, ts, 0 as seq, case when rain and not was_rain then case when i=1 then 'rain_start' else 'rain_resume' end when was_rain and not rain then 'rain_stop' end as kind from al
 union all select station_id, ts, 1, case when mc>=3 and was_mc<3 then 'ml_alert' when mc<3 and was_mc>=3 and not rain then 'ml_cancel' end from al
 union all select station_id, ts, 2, case when rc>=5 and was_rc<5 then 'radar_alert' when rc<5 and was_rc>=5 and not rain then 'radar_cancel' end from al)
"""


def _polls(spark, sf):
    radar = (F.floor(F.unix_micros("ts") / 60e6) % 997) % 5 < 4
    return _signals(spark, sf).select(KEY, "ts", F.col("is_raining").alias("wet"), F.col("any_alert").alias("alert"), radar.alias("radar"))


@query("alert_states", _recursive(READINGS, _SIG, _POLICY) + """
select station_id, epoch_us(ts) as ts_us, rain as raining, mc>=3 as confirmed_alert, rc>=5 as confirmed_radar_alert from al""")
def alert_states(spark, sf):
    return A.timeline(_polls(spark, sf)).select(KEY, ts_us("ts"), "raining", "confirmed_alert", "confirmed_radar_alert")


_GATE = """
nn as (select station_id, ts, seq, {kind} as kind, row_number() over (partition by station_id order by ts, seq) as j from nt where kind is not null),
gt as (select station_id, j, ts, seq, kind, true as ok, epoch_us(ts) as last_us, kind as last_kind from nn where j=1
 union all select station_id, j, ts, seq, kind, ok, case when ok then epoch_us(ts) else last_us end, case when ok then kind else last_kind end from (
  select nn.*, gt.last_us, gt.last_kind, nn.kind<>gt.last_kind or epoch_us(nn.ts)-gt.last_us>=1800000000 as ok
  from gt join nn on nn.station_id=gt.station_id and nn.j=gt.j+1))
"""


@query("alert_timeline", _recursive(READINGS, _SIG, _POLICY, _GATE.format(kind="kind")) + "select station_id, epoch_us(ts) as ts_us, seq, kind, ok as accepted from gt")
def alert_timeline(spark, sf):
    wanted = A.notifications(A.timeline(_polls(spark, sf)))
    return A.cooldown_gate(wanted, 1800.0).select(KEY, ts_us("ts"), "seq", "kind", "accepted")


@query("cooldown_gate", _recursive(READINGS, _SIG, _POLICY, _GATE.format(kind="left(kind, 2)")) + "select station_id, epoch_us(ts) as ts_us, seq, kind, ok as accepted from gt")
def cooldown_gate(spark, sf):
    """The gate on coarser kinds, where long same-kind chains occur."""
    wanted = A.notifications(A.timeline(_polls(spark, sf))).withColumn("kind", F.substring("kind", 1, 2))
    return A.cooldown_gate(wanted, 1800.0).select(KEY, ts_us("ts"), "seq", "kind", "accepted")


# Event audit by brute force: alerts joined to onsets by row position, one threshold grid.
def audit_sql(h: int, scope: str, confirm: int, levels) -> str:
    vals = ",".join(f"({t}::double)" for t in levels)
    hist = "(partition by station_id order by ts)"
    seg = "(partition by station_id, segment_id order by ts)"
    p60 = "(partition by station_id, segment_id order by ts rows between 60 preceding and 1 preceding)"
    l60 = "(partition by station_id, segment_id order by ts rows between 59 preceding and current row)"
    fut = f"(partition by station_id, segment_id order by ts rows between 1 following and {h} following)"
    dry = "rain_flag<=0.1" + (f" and count(*) over {l60}=60 and max(rain_flag) over {l60}<=0.1" if scope == "dry_60m" else "")
    return f"""
lv(t) as (values {vals}),
ob0 as (select station_id, ts, rain_flag, epoch_us(ts)-epoch_us(lag(ts) over {hist}) as g, row_number() over {hist} as pos from kept),
ob as (select *, sum(case when g<20000000 or g>90000000 then 1 else 0 end) over {hist} as segment_id from ob0),
fr as (select *, case when count(*) over {fut}={h} and abs(epoch_us(lead(ts,{h}) over {seg})-epoch_us(ts)-{h * 60000000})<=30000000 then (max(rain_flag) over {fut}>0.1)::int end as fo,
  lead(ts,{h}) over {seg} as fend, {dry} as dry,
  rain_flag>0.1 and count(*) over {p60}=60 and max(rain_flag) over {p60}<=0.1 and abs(epoch_us(ts)-epoch_us(lag(ts,60) over {seg})-3600000000)<=30000000 as onset from ob),
us as (select fr.*, p.probability from fr join saved p on p.station_id=fr.station_id and p.ts=fr.ts where fo is not null),
bk0 as (select *, case when pos-lag(pos) over {hist}=1 and segment_id=lag(segment_id) over {hist} then 0 else 1 end as nb from us),
bk as (select *, sum(nb) over {hist} as block from bk0),
be as (select *, min(ts) over (partition by station_id, block) as b0, max(ts) over (partition by station_id, block) as b1 from bk),
ra as (select be.*, t, dry and probability>=t as hit from be, lv),
rk as (select *, sum((not hit)::int) over (partition by station_id, t, block order by ts) as isl from ra),
rl as (select *, sum(hit::int) over (partition by station_id, t, block, isl order by ts) as streak from rk),
a as (select * from rl where hit and streak>={confirm}),
e0 as (select *, case when block=lag(block) over (partition by station_id, t order by ts) and epoch_us(ts)-epoch_us(lag(ts) over (partition by station_id, t order by ts))<=1800000000 then 0 else 1 end as ne from a),
ae as (select *, sum(ne) over (partition by station_id, t order by ts) as episode_id from e0),
ep0 as (select station_id, t, episode_id, min(ts) as f, max(ts) as l, count(*) as alert_rows, max(fo)=1 as rain, min(b0) as b0, max(b1) as b1 from ae group by 1,2,3),
ep as (select *, epoch_us(f)-epoch_us(b0)<1800000000 as lc, epoch_us(b1)-epoch_us(l)<1800000000 as rc from ep0),
sp as (select station_id, min(ts) as s0, max(fend) as s1 from us group by 1),
ev0 as (select fr.station_id, fr.ts, fr.pos, fr.segment_id, row_number() over (partition by fr.station_id order by fr.ts) as event_id,
   (select count(*) from us u where u.station_id=fr.station_id and u.pos between fr.pos-{h} and fr.pos-1)={h} as evaluable
   from fr join sp on sp.station_id=fr.station_id where fr.onset and fr.ts>s0 and fr.ts<=s1),
hit as (select ev0.station_id, event_id, ae.t, min(ae.ts) as first, list_sort(list_distinct(list(episode_id))) as ids from ev0 join ae on ae.station_id=ev0.station_id
   and ae.pos between ev0.pos-{h} and ev0.pos-1 and ae.ts<ev0.ts and ae.fend>=ev0.ts and ae.segment_id=ev0.segment_id where evaluable group by 1,2,3),
ev as (select ev0.*, lv.t, hit.first, hit.ids from ev0 cross join lv left join hit on hit.station_id=ev0.station_id and hit.event_id=ev0.event_id and hit.t=lv.t),
me as (select station_id, t, unnest(ids) as episode_id, event_id from hit),
mm as (select station_id, t, episode_id, list_sort(list_distinct(list(event_id))) as evs from me group by 1,2,3),
epm as (select ep.*, mm.evs from ep left join mm on mm.station_id=ep.station_id and mm.t=ep.t and mm.episode_id=ep.episode_id)
"""


_SAVED = "saved as (select * from pred{h})"
_GRID3 = (0.2, 0.5, 0.75)
_AUD = (READINGS, KEPT, predictions_sql(10), _SAVED.format(h=10), audit_sql(10, "dry_60m", 2, _GRID3))
_RULE = E.AuditRule(horizon=10, scope="dry_60m", confirm_streak=2)


def _kept(spark, sf):
    from ..operators.segments import collapse_bursts

    return collapse_bursts(readings(spark, sf))


def _saved(spark, sf, h):
    return predictions(spark, sf, h)


def _audit(spark, sf, rule=_RULE, levels=_GRID3):
    return E.audit(_kept(spark, sf), _saved(spark, sf, rule.horizon), levels, rule)


@query("event_audit_events", with_ctes(*_AUD) + """
select station_id, round(t,2)+0.0 as threshold, event_id, epoch_us(ts) as onset_us, evaluable, first is not null as detected, epoch_us(first) as first_matching_alert_us,
 round((epoch_us(ts)-epoch_us(first))/60e6,4)+0.0 as lead_minutes, coalesce(array_to_string(ids,','),'') as episode_ids from ev""")
def event_audit_events(spark, sf):
    return _audit(spark, sf)["events"].select(
        KEY, rd("threshold", 2).alias("threshold"), "event_id", "onset_us", "evaluable", "detected", "first_matching_alert_us",
        rd("lead_minutes", 4).alias("lead_minutes"), F.array_join("matching_episode_ids", ",").alias("episode_ids"))


@query("event_audit_episodes", with_ctes(*_AUD) + """
select station_id, round(t,2)+0.0 as threshold, cast(episode_id as bigint) as episode_id, epoch_us(f) as first_alert_us, epoch_us(l) as last_alert_us, alert_rows,
 not (lc or rc) as complete, lc as left_censored, rc as right_censored, rain as observed_rain, not rain as false_alarm, coalesce(array_to_string(evs,','),'') as event_ids from epm""")
def event_audit_episodes(spark, sf):
    return _audit(spark, sf)["episodes"].select(
        KEY, rd("threshold", 2).alias("threshold"), "episode_id", "first_alert_us", "last_alert_us", "alert_rows", "complete",
        "left_censored", "right_censored", "observed_rain", "false_alarm", F.array_join("matched_event_ids", ",").alias("event_ids"))


_SUM = """
g as (select s.station_id, t, count(*) as input_rows from saved s cross join lv group by 1,2),
u as (select station_id, count(*) as usable from us group by 1),
evs_ as (select station_id, t, count(*) as onsets, count(*) filter (where evaluable) as evaluable, count(first) as detected,
   quantile_cont((epoch_us(ts)-epoch_us(first))/60e6, 0.5) as lead_median, max((epoch_us(ts)-epoch_us(first))/60e6) as lead_max from ev group by 1,2),
eps_ as (select station_id, t, sum(alert_rows)::bigint as alert_rows, count(*) as episodes, count(*) filter (where not (lc or rc)) as complete,
   count(*) filter (where not (lc or rc) and not rain) as false_, count(*) filter (where not (lc or rc) and rain and evs is null) as noonset from epm group by 1,2),
summ as (select g.station_id, g.t, input_rows, usable, coalesce(onsets,0) as onsets, coalesce(evaluable,0) as evaluable, coalesce(detected,0) as detected,
  coalesce(alert_rows,0) as alert_rows, coalesce(episodes,0) as episodes, coalesce(complete,0) as complete, coalesce(false_,0) as false_, coalesce(noonset,0) as noonset, lead_median, lead_max,
  case when evaluable>0 then detected/evaluable end as recall, case when complete>0 then false_/complete end as far
  from g left join u on u.station_id=g.station_id left join evs_ e on e.station_id=g.station_id and e.t=g.t left join eps_ p on p.station_id=g.station_id and p.t=g.t)
"""


@query("event_summary", with_ctes(*_AUD, _SUM) + """
select station_id, round(t,2)+0.0 as threshold, input_rows as input_forecast_rows, usable as usable_forecast_rows, onsets as onsets_in_span, evaluable as evaluable_onsets,
 detected as detected_onsets, alert_rows, episodes as alert_episodes, complete as complete_alert_episodes, false_ as false_alert_episodes,
 noonset as rain_episodes_without_evaluable_new_onset, round(recall,5)+0.0 as onset_recall, round(far,5)+0.0 as false_alarm_ratio,
 round(lead_median,4)+0.0 as lead_median, round(lead_max,4)+0.0 as lead_max from summ""")
def event_summary(spark, sf):
    return _audit(spark, sf)["summary"].select(
        KEY, rd("threshold", 2).alias("threshold"), "input_forecast_rows", "usable_forecast_rows", "onsets_in_span", "evaluable_onsets",
        "detected_onsets", "alert_rows", "alert_episodes", "complete_alert_episodes", "false_alert_episodes",
        "rain_episodes_without_evaluable_new_onset", rd("onset_recall", 5).alias("onset_recall"),
        rd("false_alarm_ratio", 5).alias("false_alarm_ratio"), rd("lead_median", 4).alias("lead_median"), rd("lead_max", 4).alias("lead_max"))


_TUNE = E.AuditRule(horizon=30, scope="dry_now", confirm_streak=1)
_TUNE_SQL = (READINGS, KEPT, predictions_sql(30), _SAVED.format(h=30), audit_sql(30, "dry_now", 1, EPISODE_THRESHOLDS), _SUM)


@query("event_threshold", with_ctes(*_TUNE_SQL) + """
, ok as (select *, row_number() over (partition by station_id order by recall desc nulls last, far nulls last, alert_rows, t) as k from summ
  where coalesce(far,0)<=0.2 and alert_rows>0 and complete>0)
select s.station_id, round(coalesce(ok.t,1.0),2)+0.0 as threshold,
 case when ok.t is null then 'no_nontrivial_validation_threshold_meets_episode_budget' else 'max_onset_recall_under_false_episode_budget' end as reason,
 case when ok.t is not null then round(coalesce(recall,0),5)+0.0 end as onset_recall, case when ok.t is not null then round(coalesce(far,0),5)+0.0 end as false_alarm_ratio, ok.alert_rows
from (select distinct station_id from summ) s left join ok on ok.station_id=s.station_id and ok.k=1""")
def event_threshold(spark, sf):
    summary = _audit(spark, sf, _TUNE, EPISODE_THRESHOLDS)["summary"]
    best = E.choose_threshold(summary, [KEY])
    return best.select(KEY, rd("threshold", 2).alias("threshold"), "reason", rd("onset_recall", 5).alias("onset_recall"),
                       rd("false_alarm_ratio", 5).alias("false_alarm_ratio"), "alert_rows")
