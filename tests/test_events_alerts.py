import random

import pytest
from helpers import at, frame, series, us
from pyspark.sql import functions as F

from gaugeflow.operators import alerts as A
from gaugeflow.operators import entities as EN
from gaugeflow.operators import events as E
from gaugeflow.operators import rain_events as R
from gaugeflow.operators.revision import compare_issues, revision_notices


def _machine(rows, k=10, gap=150):
    """Rain events by stepping through the readings."""
    out, start, dry, dry_at, last = [], None, 0, None, None
    for _, ts, *_, rain in rows:
        if start is not None and (ts - last).total_seconds() > gap:
            out.append((us(start), None))
            start, dry, dry_at = None, 0, None
        last = ts
        if rain > 0.1:
            start, dry, dry_at = start or ts, 0, None
        elif start is not None:
            dry, dry_at = dry + 1, dry_at or ts
            if dry >= k:
                out.append((us(start), us(dry_at)))
                start, dry, dry_at = None, 0, None
    if start is not None:
        out.append((us(start), None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rain_events_equal_a_state_machine(spark, seed):
    rows = series(seed, 900, steps=(60, 60, 60, 60, 61, 150, 151, 60, 60, 900), wet=0.2)
    got = R.rain_events(frame(spark, rows)).orderBy("event_no").collect()
    assert [(r.start_us, r.stop_us) for r in got] == _machine(rows)


def test_rain_stop_ladder(spark):
    def status(pattern, late=0):
        rows = [(0, at(60 * i), 1.0, 50.0, 1000.0, float(c)) for i, c in enumerate(pattern)]
        now = F.lit(at(60 * (len(pattern) - 1) + late)).cast("timestamp")
        return R.rain_stop(frame(spark, rows), now).first()

    shower = "111" + "0" * 10
    assert status(shower + "1").status == "insufficient_completed_events"
    assert status(shower * 3 + "100").status == "stop_not_confirmed"
    assert status(shower * 3 + "0").status == "not_raining"
    assert status(shower * 3 + "1", late=151).status == "latest_observation_stale"
    est = status(shower * 3 + "11")
    assert (est.status, est.elapsed_minutes, est.p50, est.remaining_median, est.completed_events) == ("experimental", 1.0, 3.0, 2.0, 3)


def _policy(polls, k=3, dry_k=3, radar_k=5, cool=1800):
    prev, out = None, []
    for ts, wet, alert, radar in polls:
        was = prev["rain"] if prev else False
        dry = 0 if wet else (prev["dry"] if prev else 0) + 1
        rain = wet or (was and dry < dry_k)
        m0, r0 = (prev["m"], prev["r"]) if prev else (0, 0)
        m = m0 + 1 if alert and not rain else 0
        r = r0 + 1 if radar and not rain else 0
        want = []
        if rain and not was:
            want.append("rain_resume" if prev else "rain_start")
        if was and not rain:
            want.append("rain_stop")
        if m >= k > m0:
            want.append("ml_alert")
        elif m < k <= m0 and not rain:
            want.append("ml_cancel")
        if r >= radar_k > r0:
            want.append("radar_alert")
        elif r < radar_k <= r0 and not rain:
            want.append("radar_cancel")
        prev = {"rain": rain, "dry": dry, "m": m, "r": r}
        out += [(us(ts), w) for w in want]
    return out


def _polls(seed, n):
    rng, t, out = random.Random(seed), 0, []
    wet = alert = radar = False
    for _ in range(n):
        t += rng.choice((60, 60, 60, 4000))
        wet = not wet if rng.random() < 0.15 else wet
        alert = not alert if rng.random() < 0.2 else alert
        radar = not radar if rng.random() < 0.1 else radar
        out.append((at(t), wet, alert, radar))
    return out


def test_alert_timeline_equals_the_stepwise_policy_across_row_chunks(spark, monkeypatch):
    polls = _polls(5, 400)
    real = A.spread_rows
    monkeypatch.setattr(A, "spread_rows", lambda df, b, a, n: real(df, b, a, n, per_chunk=17))
    df = spark.createDataFrame([(0, *p) for p in polls], "station_id long, ts timestamp, wet boolean, alert boolean, radar boolean")
    got = A.notifications(A.timeline(df)).orderBy("ts", "seq").collect()
    assert [(us(r.ts), r.kind) for r in got] == _policy(polls)


def test_cooldown_compares_only_with_the_last_accepted(spark):
    rng = random.Random(9)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice((60, 600, 1700, 1800, 2500, 90_000))
        rows.append((0, at(t), 0, rng.choice("aaab")))
    kind = last = None
    want = []
    for _, ts, _, k in rows:
        ok = kind != k or us(ts) - last >= 1800e6
        if ok:
            kind, last = k, us(ts)
        want.append(ok)
    df = spark.createDataFrame(rows, "station_id long, ts timestamp, seq int, kind string")
    got = A.cooldown_gate(df, 1800.0).orderBy("ts").collect()
    assert [r.accepted for r in got] == want and 0 < sum(want) < len(want)


def test_lone_horizon_is_cleared_but_two_agree(spark):
    df = spark.createDataFrame([(1, 0.0, 0.9, 0.1, 0.1), (2, 0.0, 0.1, 0.9, 0.9), (3, 1.0, 0.9, 0.9, 0.9)], "id int, rain_flag double, p_5m double, p_10m double, p_30m double")
    got = {r.id: r for r in A.signals(df, (5, 10, 30), {5: 0.5, 10: 0.5, 30: 0.5}).collect()}
    assert (got[1].any_alert, got[1].alert_5m, got[1].signal_5m, got[1].alert_message) == (False, False, True, "No rain alert")
    assert (got[2].any_alert, got[2].next_horizon) == (True, "10m")
    assert (got[3].any_alert, got[3].suppressed_by_rain_5m, got[3].alert_message) == (False, True, "Raining now; no advance rain alert")


def _audit_input(spark, wet_from=200, n=320):
    rain = [1.0 if wet_from <= i < wet_from + 20 else 0.0 for i in range(n)]
    history = frame(spark, [(0, at(60 * i), 1.0, 50.0, 1000.0, r) for i, r in enumerate(rain)])
    saved = [(0, at(60 * i), 0.9 if 195 <= i < 200 or 60 <= i < 62 else 0.1, int(max(rain[i + 1: i + 11]) > 0.1)) for i in range(n - 10)]
    return history, saved


def test_event_audit_on_one_shower(spark):
    history, saved = _audit_input(spark)
    p = spark.createDataFrame(saved, "station_id long, ts timestamp, probability double, observed int")
    got = E.audit(history, p, (0.5,), E.AuditRule(horizon=10))
    event = got["events"].first()
    assert (event.onset_us, event.evaluable, event.detected, event.lead_minutes, event.matching_episode_ids) == (us(at(12000)), True, True, 5.0, [2])
    first, second = got["episodes"].orderBy("episode_id").collect()
    assert (first.alert_rows, first.false_alarm, first.complete, first.matched_event_ids) == (2, True, True, [])
    assert (second.alert_rows, second.observed_rain, second.matched_event_ids) == (5, True, [1])
    s = got["summary"].first()
    assert (s.onset_recall, s.false_alarm_ratio, s.false_alert_episodes, s.lead_median) == (1.0, 0.5, 1, 5.0)
    # A confirming run of three drops the two-row episode.
    strict = E.audit(history, p, (0.5,), E.AuditRule(horizon=10, confirm_streak=3))["episodes"].collect()
    assert [(e.alert_rows, e.observed_rain) for e in strict] == [(3, True)]


def test_event_audit_refuses_labels_that_disagree(spark):
    history, saved = _audit_input(spark)
    s, t, p, y = saved[30]
    saved[30] = (s, t, p, 1 - y)
    df = spark.createDataFrame(saved, "station_id long, ts timestamp, probability double, observed int")
    with pytest.raises(Exception, match="disagree"):
        E.audit(history, df, (0.5,), E.AuditRule(horizon=10))["events"].collect()
    with pytest.raises(ValueError):
        E.AuditRule(horizon=0)


def test_threshold_choice_needs_a_complete_episode(spark):
    cols = "station_id long, horizon int, threshold double, onset_recall double, false_alarm_ratio double, false_alert_episodes long, alert_rows long, complete_alert_episodes long"
    rows = [(0, 10, 0.1, 1.0, 0.5, 5, 90, 10), (0, 10, 0.2, 0.8, 0.1, 1, 50, 9), (0, 10, 0.3, 0.8, 0.1, 1, 40, 9), (0, 10, 0.9, None, None, 0, 3, 0),
            (1, 10, 0.1, 1.0, 0.9, 9, 90, 10)]
    got = {r.station_id: r for r in E.choose_threshold(spark.createDataFrame(rows, cols)).collect()}
    assert got[0].threshold == 0.3 and got[1].threshold == 1.0


def test_revision_reasons_and_cooldown(spark):
    def issue(k, p, temp):
        return [(0, at(3600 * k), at(3600 * (k + j)), p[j], temp) for j in range(3)]

    rows = issue(0, (10.0, 60.0, 60.0), 20.0) + issue(1, (60.0, 60.0, 60.0), 20.0) + issue(2, (60.0, 90.0, 0.0), 23.0) + issue(9, (0.0, 0.0, 0.0), 1.0)
    df = spark.createDataFrame(rows, "station_id long, issued_hour timestamp, valid_at timestamp, rain_prob double, temp double")
    rev = compare_issues(df)
    got = rev.orderBy("issued_hour").collect()
    assert [r.status for r in got] == ["not_comparable", "unchanged", "changed", "not_comparable"]
    assert got[0].reasons == ["missing_snapshot"] and got[3].reasons == ["no_common_valid_times"]
    assert got[2].reasons == ["rain_probability", "rain_window_shift", "temperature"] and got[2].rain_window_shift_minutes == 60.0
    assert revision_notices(rev).filter("accepted").count() == 1


def test_entity_reasons(spark):
    poll = at(3600)
    cols = "station_id long, poll_at timestamp, entity string, state string, unit string, last_reported timestamp, last_updated timestamp"

    def states(s, temp="20", temp_at=3590, rain="off", rain_at=0, hum_at=3100):
        return [(s, poll, "temp", temp, "°C", at(temp_at) if temp_at is not None else None, None), (s, poll, "humidity", "0.5", "ratio", None, at(hum_at)),
                (s, poll, "pressure", "101325", "Pa", at(3595), None), (s, poll, "rain", rain, None, at(rain_at), None), (s, poll, "light", "900", "lx", at(10), None)]

    rows = states(0) + states(1, temp_at=3400) + states(2, temp="warm") + states(3, rain="0.4") + states(4, rain="0.4", rain_at=3580) + states(5, rain="??", rain_at=3590) + states(6, hum_at=2999) + states(7, temp_at=None)
    got = {r.station_id: r for r in EN.assemble(spark.createDataFrame(rows, cols), F.col("poll_at")).collect()}
    assert [got[i].reason for i in range(8)] == [None, "stale_temp", "invalid_temp", "stale_rain", None, "invalid_rain", "stale_humidity", "missing_timestamp_temp"]
    assert (got[0].temp, got[0].humidity, got[0].pressure, got[0].rain, got[0].light) == (20.0, 50.0, 1013.25, False, None)
    assert us(got[0].ts) == us(at(3100)) and (got[4].rain, got[4].rain_sensor) == (True, 0.4)
