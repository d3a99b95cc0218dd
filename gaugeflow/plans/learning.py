"""Model queries (row checks only: forests are not comparable with SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as M
from ..operators.chunks import KEY
from ..operators.features import feature_names, labelled_features
from ..operators.labels import common_rows, split
from ..operators.lineage import cut
from ..operators.segments import FILLED
from .fixtures import readings
from .registry import query, rd, ts_us

RULE = M.ForestRule(blend=True)


def _rows(spark, sf, horizons):
    names = feature_names()
    df = labelled_features(readings(spark, sf).drop("rn"), horizons, names)
    return cut(common_rows(df, horizons, names), "examples")


@query("rf_score")
def rf_score(spark, sf):
    """Two window horizons fitted on all features, projected jointly and scored on all usable rows."""
    rows = _rows(spark, sf, (10, 30))
    models = [M.fit_horizon(rows, feature_names(), h, f"rain_{h}m", RULE)[0] for h in (10, 30)]
    return M.predict_horizons(models, rows).select(KEY, ts_us("ts"), *[rd(f"p_{h}m", 4).alias(f"p_{h}m") for h in (10, 30)])


@query("rf_holdout")
def rf_holdout(spark, sf):
    """Scored validation and test rows of one horizon with the sigmoid calibration and the blend."""
    rows = _rows(spark, sf, (30,))
    _, judged = M.fit_horizon(rows, feature_names(), 30, "rain_30m", RULE)
    return judged.select(KEY, ts_us("ts"), "part", "observed", rd("raw_probability", 4).alias("raw_probability"), rd("probability", 4).alias("probability"))


@query("temp_score")
def temp_score(spark, sf):
    """Every real row; a row that lacks a feature has no forecast."""
    names = feature_names()
    rows = labelled_features(readings(spark, sf).drop("rn"), (30,), names).filter(F.col(FILLED) <= 0)
    rows = cut(rows, "examples")
    model = M.fit_temperature(rows, names, "temp_ahead_30m")
    return M.predict_temperature(model, rows).select(KEY, ts_us("ts"), rd("temp_forecast", 4).alias("temp_forecast"), rd("delta", 4).alias("delta"))


#: Boosted trees, fewer than by default: each is fitted after the one before.
BOOSTED = M.ForestRule(kind="gbt", trees=60)


def _cohorts(model):
    return [(name, *[f[c] for c in _FACTS]) for name, f in model.metrics["cohorts"].items()]


_FACTS = ("n", "positive_rows", "brier", "average_precision", "climatology_brier", "persistence_brier", "brier_skill", "threshold", "precision", "recall", "f1")
_FACT_KINDS = "cohort string, n long, positive_rows long, " + ", ".join(f"{c} double" for c in _FACTS[2:])


@query("rf_metrics")
def rf_metrics(spark, sf):
    """Test metrics of a forest per cohort, against climatology and persistence."""
    rows = _rows(spark, sf, (30,))
    model, _ = M.fit_horizon(rows, feature_names(), 30, "rain_30m", RULE)
    return spark.createDataFrame(_cohorts(model), _FACT_KINDS)


@query("gbt_holdout")
def gbt_holdout(spark, sf):
    """Scored validation and test rows of one horizon by boosted trees."""
    rows = _rows(spark, sf, (30,))
    _, judged = M.fit_horizon(rows, feature_names(), 30, "rain_30m", BOOSTED)
    return judged.select(KEY, ts_us("ts"), "part", "observed", rd("raw_probability", 4).alias("raw_probability"), rd("probability", 4).alias("probability"))


@query("temp_errors")
def temp_errors(spark, sf):
    """Errors of the temperature forest on the newest fifth of the rows, beside those of persistence."""
    names = feature_names()
    rows = labelled_features(readings(spark, sf).drop("rn"), (30,), names).filter((F.col(FILLED) <= 0) & F.col("temp_ahead_30m").isNotNull())
    # Stored before they are split: the times of the split and the parts would each make all features again.
    parts = split(cut(rows.select(KEY, "ts", "temp_ahead_30m", *names), "examples"), 30)
    model = M.fit_temperature(parts.filter("part <> 'test'"), names, "temp_ahead_30m")
    return M.temperature_errors(model, parts.filter("part = 'test'"), "temp_ahead_30m")
