"""Outliers, crowds, long chains, repeated rows and nulls must not change or lose results."""

import datetime
import random

import pytest
from helpers import at, frame, series
from pyspark.sql import functions as F

from gaugeflow.functions.units import number
from gaugeflow.operators import alerts as A
from gaugeflow.operators import events as E
from gaugeflow.operators import metrics as M
from gaugeflow.operators import radar as R
from gaugeflow.operators.features import feature_frame
from gaugeflow.operators.learning import ForestRule, _classifier, class_weights, fit_horizon, fit_temperature, joint_thresholds, predict_temperature
from gaugeflow.operators.quantiles import bucket_of, cut_bounds, exact_quantiles
from gaugeflow.operators.scoring import score_recent
from gaugeflow.operators.summaries import trailing_summary
from gaugeflow.policy import GridPolicy
from gaugeflow.sources.history import append_by_date, newest_days, scan_csv


def test_quantile_buckets_stay_even_beside_an_outlier(spark):
    df = spark.range(10_000).select(F.lit(1).alias("g"), F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") / 7).alias("v"))
    bounds = df.groupBy("g").agg(cut_bounds("v").alias("b"))
    sizes = df.join(bounds, "g").groupBy(bucket_of(F.col("v"), F.col("b")).alias("k")).count()
    assert sizes.agg(F.max("count")).first()[0] < 300
    odd = df.unionByName(spark.createDataFrame([(1, float("nan")), (1, float("inf")), (1, None)], "g int, v double"))
    row = exact_quantiles(odd, ["g"], "v", (0.5, 1.0)).first()
    assert row.n == 10_000 and row.q[1] == 1e9


def test_average_precision_with_crowded_scores(spark):
    draw = random.Random(1)
    rows = [(draw.random() ** 20, int(draw.random() < 0.05)) for _ in range(3000)]
    hits, total = 0, 0.0
    for k, (_, y) in enumerate(sorted(rows, reverse=True), 1):
        hits += y
        total += y * hits / k
    got = M.average_precision(spark.createDataFrame(rows, "probability double, observed int"), []).first()
    assert got.average_precision == pytest.approx(total / hits)


def greedy(rows, cooldown):
    last, out = None, {}
    for us, seq, kind in sorted(rows):
        ok = last is None or last[1] != kind or us - last[0] >= cooldown * 1e6
        last = (us, kind) if ok else last
        out[us, seq] = ok
    return out


@pytest.mark.parametrize("spread,kinds", [(200, "a"), (900, "ab"), (40, "aaaaaaaaaaaaaaaaaaaab")])
def test_cooldown_over_chains_of_many_days(spark, spread, kinds):
    draw, t, rows = random.Random(spread), 0, []
    for _ in range(3000):
        t += draw.choice([0, draw.randint(1, spread), draw.randint(1, spread)])
        rows.append((t * 1_000_000, len(rows) % 3 if rows and rows[-1][0] == t * 1_000_000 else 0, draw.choice(kinds)))
    rows = list({(u, s): (u, s, k) for u, s, k in rows}.values())
    wanted = spark.createDataFrame(rows, "us long, seq int, kind string").select(F.lit(7).alias("station_id"), F.timestamp_micros("us").alias("ts"), "seq", "kind")
    got = {(r.us, r.seq): r.accepted for r in A.cooldown_gate(wanted, 1800.0).select(F.unix_micros("ts").alias("us"), "seq", "accepted").collect()}
    assert got == greedy(rows, 1800.0)


def test_a_flapping_sensor_is_graded_in_parts(spark):
    wanted = spark.range(200_000).select(F.lit(1).alias("station_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.lit(0).alias("seq"), F.lit("a").alias("kind"))
    assert A.cooldown_gate(wanted, 1800.0).filter("accepted").count() == -(-200_000 // 1800)


def test_audit_refuses_repeated_predictions_and_wrong_dry_flags(spark):
    history = frame(spark, series(1, 300, wet=0.1)).select("station_id", "ts", "rain_flag")
    rule = E.AuditRule(horizon=5, target="rain_window")
    label = E.audit_frame(history, history.select("station_id", "ts", F.lit(0.5).alias("probability"), F.lit(0).alias("observed")).limit(0), rule)
    truth = label.filter("_core and _future is not null").select("station_id", F.timestamp_micros("_us").alias("ts"), F.col("_future").cast("int").alias("observed"), "dry_now")
    good = truth.withColumn("probability", F.lit(0.5))
    assert E.audit(history, good, (0.4,), rule)["summary"].count() == 1
    for bad, message in ((good.unionByName(good.limit(1)), "repeated"), (good.withColumn("dry_now", ~F.col("dry_now")), "dry flags")):
        with pytest.raises(Exception, match=message):
            E.audit(history, bad, (0.4,), rule)["summary"].collect()


def test_common_times_refuse_repeats(spark):
    df = spark.createDataFrame([(1, 5), (1, 10), (1, 10)], "k int, horizon int")
    with pytest.raises(Exception, match="repeated"):
        M.common_times(df, 2, ["k"]).collect()


def test_rolling_extremes_are_null_while_a_null_is_in_the_frame(spark):
    rows = [(1, at(60 * k), None if k == 5 else 20.0 + k, 50.0, 1000.0, 0.0) for k in range(40)]
    df = feature_frame(spark.createDataFrame(rows, "station_id long, ts timestamp, temp double, humidity double, pressure double, rain_flag double"))
    got = [r.temp_min_15m for r in df.orderBy("ts").collect()]
    assert all((v is None) == (k < 14 or 5 <= k <= 19) for k, v in enumerate(got))


def test_numbers_without_type_suffixes(spark):
    texts = ["1d", "1f", "1e3", " -2.5 ", "+.5", "3.", "nan", "inf", "", "1 2", "0x1"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(number(F.col("t")).alias("v")).collect()]
    assert got == [None, None, 1000.0, -2.5, 0.5, 3.0, None, None, None, None, None]


def test_csv_keeps_every_station(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station_id,timestamp,temp,humidity,pressure,rain_flag\n1,2024-01-01 00:00:00,20,50,1000,0\n2,2024-01-01 00:00:00,21,50,1000,0\n2,2024-01-01 00:00:00,22,50,1000,0\n")
    rows = scan_csv(spark, [str(tmp_path / "a.csv")]).collect()
    assert sorted((str(r.station_id), r.temp) for r in rows) == [("1", 20.0), ("2", 22.0)]


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_bounds_reach_the_scan(spark, tmp_path):
    r = frame(spark, series(2, 50)).select("station_id", "ts", "temp", "humidity", "pressure", "rain_flag")
    r.write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(1, at(0), at(300), 5, 0.4, "a")], "station_id long, issued_at timestamp, valid_at timestamp, lead_minutes int, rain_prob double, source_layer string").write.parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    now = F.lit(datetime.datetime(2024, 1, 9)).cast("timestamp")
    text = plan(trailing_summary(stored, now))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    text = plan(score_recent(spark.read.parquet(str(tmp_path / "f")), stored, now))
    assert "GreaterThanOrEqual(issued_at" in text and "LessThan(issued_at" in text and "GreaterThanOrEqual(ts" in text


def test_newest_days_prune_partitions(spark, tmp_path):
    df = spark.range(5).select(F.timestamp_micros(F.col("id") * 86_400_000_000).alias("ts"), F.col("id").alias("v"))
    append_by_date(df, str(tmp_path / "t"))
    got = newest_days(spark.read.parquet(str(tmp_path / "t")), 2)
    assert sorted(r.v for r in got.collect()) == [3, 4]
    text = plan(got)
    assert text.count("FileScan") == 1 and "date#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.v for r in newest_days(df.withColumn("date", F.to_date("ts")), 2).collect()) == [3, 4]


def test_dry_and_untracked_regions_have_an_outlook(spark):
    px = [(g, f * 600, 10 + 2 * f, 10, 2) for g in (1, 2) for f in range(4) if not (g == 2 and f > 1)] + [(3, 1800, 10, 10, 2)]
    pixels = spark.createDataFrame(px, "region long, frame_time long, x int, y int, bucket int")
    frames = spark.createDataFrame([(g, f * 600) for g in (1, 2, 3) for f in range(4)], "region long, frame_time long")
    grid = GridPolicy(window=60)
    speed = R.velocity(R.motion(pixels, ["region"], frames, grid), ["region"], 4, F.lit(1000.0))
    got = {r.region: r for r in R.outlook(pixels, frames, speed, ["region"], F.lit(20), F.lit(10), F.lit(60), F.lit(60), grid).collect()}
    assert got[1].rain_arriving and got[1].confidence > 0.5
    assert all((got[g].rain_arriving, got[g].confidence, got[g].motion_kmh) == (False, 0.0, None) for g in (2, 3))


def test_only_the_newest_frames_count(spark):
    pixels = spark.createDataFrame([(f * 600, 10 + (2 if f > 2 else 8) * f, 10, 1) for f in range(6)], "frame_time long, x int, y int, bucket int")
    assert R.motion(pixels, [], pixels.select("frame_time"), GridPolicy(window=60, frames=3)).count() == 2


def _examples(spark, stations=2, rows=400):
    draw, out = random.Random(7), []
    for s in range(stations):
        for k in range(rows if s else 60):
            a = draw.random()
            out.append((s, at(600 * k), 0.0, 0.0, a, draw.random(), float(a + draw.random() * 0.5 > 0.9)))
    return spark.createDataFrame(out, "station_id long, ts timestamp, rain_flag double, rain_last_60m double, a double, b double, target double")


def test_short_stations_are_counted_and_bad_parts_refused(spark):
    rows = _examples(spark)
    model, judged = fit_horizon(rows, ["a", "b"], 5, "target", ForestRule(trees=4, depth=3))
    assert model.metrics["short_stations"] == 1 and model.metrics["short_rows"] == 60
    assert {r.station_id for r in judged.select("station_id").distinct().collect()} == {1}
    for bad in (rows.filter("station_id = 0"), rows.withColumn("target", F.when(F.col("ts") < F.lit(at(600 * 250)), F.col("target")).otherwise(0.0))):
        with pytest.raises(ValueError, match="part"):
            fit_horizon(bad, ["a", "b"], 5, "target", ForestRule(trees=2, depth=2))


def test_depth_is_what_was_asked_for():
    assert ForestRule().levels == 18 and ForestRule(kind="gbt").levels == 5 and ForestRule(kind="gbt", depth=8).levels == 8
    assert _classifier(ForestRule(kind="gbt", depth=8, trees=2)).getMaxDepth() == 8


def test_onset_models_balance_their_classes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.5)], "target double, weight double")
    assert sorted(r.weight for r in class_weights(df).collect()) == pytest.approx(sorted([2 * 2.0, 4 / 6, 4 / 6, 1.0]))


def test_temperature_keeps_every_row(spark):
    rows = spark.createDataFrame([(float(k), None if k % 10 == 0 else float(k), 20.0, 20.0 + k if k % 7 else None) for k in range(80)], "a double, b double, temp double, ahead double")
    model = fit_temperature(rows, ["a", "b"], "ahead", trees=3, depth=3)
    got = predict_temperature(model, rows)
    assert got.count() == 80 and got.filter("temp_forecast is null").count() == 8


def test_joint_thresholds_refuse_rows_that_differ(spark):
    rows = [(1, at(60 * k), "validation" if k % 2 else "test", k / 50, int(k > 30)) for k in range(50)]
    full = spark.createDataFrame(rows, "station_id long, ts timestamp, part string, probability double, observed int")
    wide, chosen = joint_thresholds({5: full, 10: full})
    assert wide.count() == 50 and set(chosen) == {5, 10}
    for bad in (full.limit(49), full.unionByName(full.limit(1))):
        with pytest.raises(ValueError, match="different rows"):
            joint_thresholds({5: full, 10: bad})
