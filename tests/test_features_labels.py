import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import SCHEMA, at, frame, series, us
from pyspark.sql import functions as F

from gaugeflow.operators import features as X
from gaugeflow.operators import labels as L
from gaugeflow.operators import segments as S


@pytest.fixture(scope="module")
def history(spark):
    steady = (60,) * 120 + (61, 130, 700)
    return frame(spark, series(5, 900, steps=steady)).dropDuplicates(["station_id", "ts"]).cache()


def plain(spark, history):
    """Repaired series with segment ids, as pandas."""
    return S.repaired_series(history).orderBy("ts").toPandas()


def test_feature_schema():
    names = X.feature_names()
    assert len(names) == 202 and len(set(names)) == 202
    onset = X.onset_feature_names()
    assert len(onset) == 190 and not [n for n in onset if n.startswith("rain_")]
    with pytest.raises(ValueError):
        X.check_onset_features(["temp", "rain_now"])


def test_rolling_features_equal_pandas(spark, history):
    base = plain(spark, history)
    names = ["temp_avg_15m", "temp_std_5m", "temp_std_60m", "temp_min_30m", "humidity_max_60m", "pressure_std_120m", "pressure_avg_90m",
             "rain_last_120m", "rain_frac_10m", "rain_slope_10m", "pressure_accel_30m", "temp_slope_10m"]
    got = X.feature_frame(history, names).orderBy("ts").toPandas()
    g = base.groupby("segment_id")

    def roll(c, n, fn):
        return g[c].transform(lambda s: getattr(s.rolling(n, min_periods=n), fn)())

    frac = roll("rain_flag", 10, "mean")
    delta = base.pressure - g.pressure.shift(30)
    minutes = (base.ts - g.ts.shift(10)).dt.total_seconds() / 60
    want = {
        "temp_avg_15m": roll("temp", 15, "mean"), "temp_std_5m": roll("temp", 5, "std"), "temp_std_60m": roll("temp", 60, "std"),
        "temp_min_30m": roll("temp", 30, "min"), "humidity_max_60m": roll("humidity", 60, "max"), "pressure_std_120m": roll("pressure", 120, "std"),
        "pressure_avg_90m": roll("pressure", 90, "mean"), "rain_last_120m": roll("rain_flag", 120, "max"), "rain_frac_10m": frac,
        "rain_slope_10m": frac - frac.groupby(base.segment_id).shift(10),
        "pressure_accel_30m": delta - delta.groupby(base.segment_id).shift(30), "temp_slope_10m": (base.temp - g.temp.shift(10)) / minutes,
    }
    assert list(got.ts) == list(base.ts)
    for n in names:
        np.testing.assert_allclose(got[n].to_numpy(float), want[n].to_numpy(float), atol=1e-9, err_msg=n)


def test_labels_equal_a_row_by_row_reading_of_the_rule(spark, history):
    base = plain(spark, history)
    t = [us(x.to_pydatetime()) for x in base.ts]
    rain, filled, seg = base.rain_flag.tolist(), base[S.FILLED].tolist(), base.segment_id.tolist()

    def complete(i, n):
        j = i + n
        return j < len(t) and seg[j] == seg[i] and abs(t[j] - t[i] - n * 60e6) <= 30e6 and max(filled[i + 1: j + 1]) <= 0

    def onset(i):
        j = i - 60
        if rain[i] <= 0.1 or filled[i] or j < 0 or seg[j] != seg[i]:
            return 0
        return int(max(rain[j:i]) <= 0.1 and max(filled[j:i]) <= 0 and abs(t[i] - t[j] - 3600e6) <= 30e6)

    flags = [onset(i) for i in range(len(t))]
    got = L.label_rows(history, (5, 30)).orderBy("ts").collect()
    assert [r.onset for r in got] == flags
    for n in (5, 30):
        window = [int(max(rain[i + 1: i + n + 1]) > 0.1) if complete(i, n) else None for i in range(len(t))]
        ahead = [max(flags[i + 1: i + n + 1]) if complete(i, n) else None for i in range(len(t))]
        assert [r[f"rain_{n}m"] for r in got] == window
        assert [r[f"onset_{n}m"] for r in got] == ahead


def test_split_purges_labels_that_cross(spark):
    rows = [(0, at(60 * i), 1.0, 50.0, 1000.0, 0.0) for i in range(200)] + [(1, at(60 * i), 1.0, 50.0, 1000.0, 0.0) for i in range(50)]
    got = L.split(frame(spark, rows), 10).collect()
    index = {p: sorted((us(r.ts) - us(at(0))) // 60_000_000 for r in got if r.part == p and r.station_id == 0) for p in ("train", "calibration", "validation", "test")}
    assert (index["train"][0], index["train"][-1]) == (0, 109)  # row 110 would end at 120.5 > 120
    assert (index["calibration"][0], index["calibration"][-1]) == (120, 129)
    assert (index["validation"][0], index["validation"][-1]) == (140, 149)
    assert (index["test"][0], index["test"][-1]) == (160, 199)
    assert {r.part for r in got if r.station_id == 1} == {"too_short"}


def test_onset_weights_share_the_positive_mass(spark):
    target = [0, 1, 1, 1, 0, 0, 1, 0]
    rows = [(0, at(60 * i), 1.0, 90.0 if i == 4 else 50.0, 1000.0, float(y)) for i, y in enumerate(target)]
    got = L.onset_weights(frame(spark, rows), "rain_flag").orderBy("ts").collect()
    assert [round(r.weight, 6) for r in got] == [1.0] + [round(2 / 3, 6)] * 3 + [1.5, 1.0, 2.0, 1.0]


def test_context_marks_missing_sources(spark):
    df = spark.createDataFrame([("NNE", "yes", None), ("400", None, 3.0)], "wind_direction string, wind_available string, wind_speed double")
    a, b = X.with_context(df).collect()
    assert (a.wind_direction, a.wind_available, a.nwp_missing, a.nwp_age_seconds_now) == (22.5, 1.0, 1.0, 999999.0)
    assert b.wind_available == 1.0 and math.isclose(b.wind_direction_sin, math.sin(math.radians(40)))



def test_features_as_arrays_are_those_of_the_expressions(spark):
    rng = random.Random(8)
    rows = [(*r[:2], *[v if rng.random() > 0.02 else None for v in r[2:]], *[rng.choice([None, rng.randrange(9000) / 7]) for _ in range(3)])
            for station in (0, 1) for r in series(station + 3, 1500, steps=(60,) * 60 + (58, 63, 130, 300, 700), station=station)]
    history = frame(spark, rows, SCHEMA + ", light double, wind_speed double, wind_gust double")
    names = X.feature_names()
    made = X.labelled_features(history, (30,), names)
    # Rows went through hundreds of window frames before; now through one function of a chunk, without a further shuffle.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("Exchange hashpartitioning(station_id") == 1
    got, want = (df.orderBy("station_id", "ts").select("station_id", "ts", *names).collect() for df in (made, X.feature_frame(history, names)))
    assert len(got) == len(want) > 3000
    for a, b in zip(got, want):
        assert a == b
    assert all(any(r[n] is not None for r in got) for n in names)


def test_chunks_of_a_station_are_dealt_out_however_the_rows_come(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("station_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), *[
        F.lit(1.0).alias(c) for c in ("temp", "humidity", "pressure", "rain_flag")])
    plan = S.repaired_chunks(rows.repartition(4, "station_id"))._jdf.queryExecution().executedPlan().toString()
    assert any("_chunk" in e.split(")")[0] for e in plan.split("Exchange hashpartitioning(station_id")[1:])  # by station alone before
