"""Registry, oracle agreement on the smallest data, and the shape of the plans."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import compare as cmp  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
from gaugeflow.operators.clean import time_range  # noqa: E402
from gaugeflow.operators.learning import default_features, fit_horizon, fit_temperature, temperature_errors, ForestRule, predict  # noqa: E402
from gaugeflow.plans import load_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "gap_fill", "segments_audit", "feat_rate", "label_onset", "split_purged", "asof_nwp", "match_window", "forecast_score",
    "reliability", "bias_fit", "drift_compare", "rain_events", "alert_timeline", "event_summary", "entity_assembly",
    "nwp_hourly_flatten", "daily_summary", "revision", "warnings_match", "radar_eta",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_a_query_and_names_are_stable():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and set(load_queries()) <= set(queries) and len(load_queries()) >= 110
    assert set(load_queries()) - set(oracles) == {"rf_score", "rf_holdout", "rf_metrics", "gbt_holdout", "temp_score", "temp_errors"}


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_equals_sql(spark, name):
    q = load_queries()[name]
    verdict, *_ = cmp.compare(spark, cmp.connect(SF), name, q.build, q.oracle, SF)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", ["feat_roll", "label_onset", "asof_nwp", "match_window", "threshold_sweep", "warnings_match", "radar_motion", "alert_timeline"])
def test_plans_stay_on_the_jvm_without_pair_joins(spark, name):
    plan = load_queries()[name].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "ArrowEval", "FlatMapGroupsInPandas"):
        assert bad not in plan, bad


def test_feature_windows_share_one_shuffle_of_the_readings(spark):
    from gaugeflow.operators.features import feature_frame

    r = spark.read.parquet(f"{SF}/events.parquet").select(
        (F.col("user_id") % 4).alias("station_id"), F.col("ts").cast("timestamp").alias("ts"),
        *[F.col("value").alias(c) for c in ("temp", "humidity", "pressure", "rain_flag")])
    plan = feature_frame(r, ["temp_std_60m", "rain_slope_30m", "pressure_accel_30m"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(station_id") == 1
    assert "_chunk" in plan.split("Exchange hashpartitioning(station_id")[1].split(")")[0]


def test_time_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.range(10).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("temp"), F.lit(1).alias("other")).write.parquet(path)
    df = time_range(spark.read.parquet(path), "ts", F.expr("timestamp'1970-01-01 00:00:05'")).select("temp")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "other" not in plan.split("ReadSchema")[1]
    assert df.count() == 5


def test_models_learn_and_onset_models_refuse_rain_inputs(spark):
    rows = spark.range(1200).select(
        F.lit(0).cast("long").alias("station_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), ((F.col("id") * 37) % 101 / 100.0).alias("a"),
        ((F.col("id") * 11) % 7).cast("double").alias("b"), F.lit(0.0).alias("rain_flag"), F.lit(0.0).alias("rain_last_60m"))
    rows = rows.withColumn("target", (F.col("a") > 0.6).cast("int")).cache()
    model, judged = fit_horizon(rows, ["a", "b"], 5, "target", ForestRule(trees=5, depth=4, blend=True))
    assert model.metrics["f1"] > 0.95 and model.metrics["brier"] < 0.05 and model.metrics["n"] > 200
    cohorts = model.metrics["cohorts"]
    assert set(cohorts) == {"all", "dry_now", "dry_60m"} and cohorts["all"]["brier"] == pytest.approx(model.metrics["brier"])
    assert all(c["brier"] < 0.5 * c["persistence_brier"] and c["brier_skill"] > 0.5 and c["average_precision"] > 0.95 for c in cohorts.values())
    assert {r.part for r in judged.select("part").distinct().collect()} == {"validation", "test"}
    p = predict(model, rows).agg(F.min("p_5m").alias("lo"), F.max("p_5m").alias("hi")).first()
    assert 0 <= p.lo < 0.3 and 0.7 < p.hi <= 1
    assert default_features("rf_onset", ["temp", "rain_now"]) == ["temp"]
    with pytest.raises(ValueError):
        fit_horizon(rows, ["a", "rain_last_60m"], 5, "target", ForestRule(kind="rf_onset", trees=2, depth=2))
    boosted, _ = fit_horizon(rows, ["a", "b"], 5, "target", ForestRule(kind="gbt", trees=3, depth=2))
    assert boosted.metrics["f1"] > 0.9


def test_the_temperature_forest_beats_persistence(spark):
    rows = spark.range(3000).select(
        F.lit(0).cast("long").alias("station_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (20 + 5 * F.sin(F.col("id") / 40)).alias("temp"), F.cos(F.col("id") / 40).alias("slope"),
        (20 + 5 * F.sin((F.col("id") + 30) / 40)).alias("ahead"))
    rows = rows.withColumn("ahead", F.when(F.col("ts") < F.timestamp_seconds(F.lit(2970 * 60)), F.col("ahead"))).cache()
    model = fit_temperature(rows.filter("unix_seconds(ts) < 120000"), ["temp", "slope"], "ahead", trees=5, depth=6)
    r = temperature_errors(model, rows.filter("unix_seconds(ts) >= 120000"), "ahead").first()
    assert r.n == 970 and r.mae < 0.2 * r.persistence_mae and r.rmse < 0.2 * r.persistence_rmse
