import random

import pytest
from helpers import at, frame, us
from pyspark.sql import functions as F

from gaugeflow.operators import asof as A
from gaugeflow.operators import scoring as S
from gaugeflow.operators.calibrate import apply_interval, fit_bias, fit_interval, look_up_bias
from gaugeflow.policy import HOUR, BiasPolicy, IntervalPolicy

LOG = "station_id long, issued_at timestamp, valid_at timestamp, lead_hours int, temp double"
FORECAST = "station_id long, issued_at timestamp, valid_at timestamp, lead_minutes int, rain_prob double, source_layer string"
READING = "station_id long, ts timestamp, rain_flag double"


def _log(rng, n):
    out = []
    for k in range(n):
        issued = rng.randrange(0, 400_000, 600)
        lead = rng.randrange(0, 7)
        out.append((0, at(issued), at(issued + lead * 3600), lead, float(k)))
    return out


def test_asof_equals_the_two_inequalities_and_never_leaks(spark):
    rng = random.Random(3)
    log = _log(rng, 120)
    times = sorted(rng.sample(range(-5000, 450_000), 150))
    r = spark.createDataFrame([(0, at(t)) for t in times], "station_id long, ts timestamp")

    def run(rows):
        out = A.asof_known(r, frame(spark, rows, LOG), ["lead_hours", "temp"], span=6 * HOUR)
        return {us(x.ts): (x.nwp_valid_at, x.nwp_issued_at) for x in out.collect()}

    got = run(log)
    for t in times:
        known = [(v, i) for _, i, v, _, _ in log if us(i) <= us(at(t)) and us(at(t)) - 6 * HOUR <= us(v) <= us(at(t))]
        want = max(known, default=None)
        v, i = got[us(at(t))]
        assert (None if v is None else (us(v), us(i))) == (None if want is None else (us(want[0]), us(want[1])))
    t0 = times[75]
    later = run([x for x in log if us(x[1]) <= us(at(t0))])
    assert all(got[us(at(t))] == later[us(at(t))] for t in times if t <= t0)


def test_nearest_takes_the_earlier_of_equal_distances(spark):
    left = spark.createDataFrame([(0, at(86400 - 43200)), (0, at(1000)), (0, at(5000))], "station_id long, valid_at timestamp")
    right = spark.createDataFrame([(0, at(43200 - 60), 1.0), (0, at(43200 + 60), 2.0), (0, at(520), 3.0), (0, at(4519), 4.0)], "station_id long, ts timestamp, temp double")
    got = {us(r.valid_at): r.temp for r in A.nearest_within(left, "valid_at", right, "ts", "temp", 480.0).collect()}
    assert got == {us(at(43200)): 1.0, us(at(1000)): 3.0, us(at(5000)): None}  # 481 s is too far


def test_point_match_only_searches_three_minutes(spark):
    f = frame(spark, [(0, at(v - 300), at(v), 5, 0.5, "radar") for v in (359, 3601, 7230)], FORECAST)
    # 85 s later but two minute buckets on: not found; equal distance: same bucket first; 30 s before: found.
    r = frame(spark, [(0, at(444), 1.0), (0, at(3601 - 20), 1.0), (0, at(3601 + 20), 0.0), (0, at(7200), 1.0)], READING)
    got = {us(x.valid_at): x.actual for x in A.match_point(f, r).collect()}
    assert got == {us(at(359)): None, us(at(3601)): 0, us(at(7230)): 1}


def _greedy(issue, lead, readings):
    """Minute by minute, nearest unused reading."""
    seen = sorted((t, w) for t, w in readings if issue < t <= issue + lead * 60 + 30)
    used, wet = set(), False
    for k in range(1, lead + 1):
        best = None
        for i, (t, w) in enumerate(seen):
            d = abs(t - issue - k * 60)
            if i not in used and d <= 30 and (best is None or d < best[0]):
                best = (d, i, w)
        if best is None:
            return None
        used.add(best[1])
        wet = wet or best[2]
    return int(wet)


def test_window_match_equals_greedy_with_readings_on_slot_edges(spark):
    rng = random.Random(11)
    forecasts, readings, want = [], [], {}
    for s in range(60):
        times = sorted({60 * k + rng.choice((-30, -30, 0, 10, 30, 30)) for k in range(1, 40) for _ in range(rng.choice((1, 1, 2)))})
        rows = [(t, rng.random() < 0.05) for t in times]
        readings += [(s, at(t), 1.0 if w else 0.0) for t, w in rows]
        for lead in (3, 10):
            issue = rng.choice((0, 60, 600))
            forecasts.append((s, at(issue), at(issue + lead * 60), lead, 0.1, "local_rf"))
            want[(s, us(at(issue)), lead)] = _greedy(issue, lead, rows)
    got = A.match_window(frame(spark, forecasts, FORECAST), frame(spark, readings, READING)).collect()
    assert {(x.station_id, us(x.issued_at), x.lead_minutes): x.actual for x in got} == want
    assert {None, 0, 1} <= set(want.values())


def test_score_needs_climatology_for_the_whole_group(spark):
    rows = [(0, "a", 5, 0.5, 1, 0.2), (0, "a", 5, 0.1, 0, 0.2), (0, "b", 60, 0.5, 1, None), (0, "b", 60, 0.5, 0, 0.3)]
    df = spark.createDataFrame(rows, "station_id long, source_layer string, lead_minutes int, rain_prob double, actual int, climatology double")
    got = {r.source_layer: r for r in S.score(df).collect()}
    assert got["a"].n == 2 and abs(got["a"].skill_score - (1 - 0.13 / 0.34)) < 1e-9
    assert got["b"].climatology_brier is None and got["b"].skill_score is None
    assert S.storable(S.score(df)).count() == 1


def test_bias_falls_back_and_is_clamped(spark):
    pairs = [(1, 3, 9.0)] * 5 + [(2, 4, 1.0)] * 2 + [(2, 4, 2.0)]
    df = spark.createDataFrame(pairs, "lead_hours int, issue_hour int, error_c double")
    model = fit_bias(df, policy=BiasPolicy(min_samples=3)).cache()
    q = spark.createDataFrame([(1, 4), (7, 4), (7, 9), (2, 3)], "lead_hours int, h int")
    got = {(r.lead_hours, r.h): r.correction for r in look_up_bias(q, model, F.col("h")).collect()}
    assert got == {(1, 4): 6.0, (7, 4): 1.0, (7, 9): 6.0, (2, 3): 1.0}
    assert fit_bias(df, policy=BiasPolicy(min_samples=9)).count() == 0


def test_interval_of_a_corrected_centre_is_not_put_on_raw_forecasts(spark):
    df = spark.createDataFrame([(1, 0, float(e)) for e in range(11)], "lead_hours int, issue_hour int, error_c double")
    model = fit_interval(df, policy=IntervalPolicy(min_samples=5)).cache()
    t = spark.createDataFrame([(1, 20.0), (9, None)], "lead_hours int, temp double")
    a, b = apply_interval(t, model).orderBy("lead_hours").collect()
    assert (a.interval_lower, a.interval_upper, b.interval_lower) == (21.0, 29.0, None)
    assert apply_interval(t, model, center="nwp_bias_correction").filter("interval_lower is not null").count() == 0
