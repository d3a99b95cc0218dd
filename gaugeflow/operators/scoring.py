"""Live forecast scoring against what happened and against hour-of-day climatology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import DAY, HOUR, MINUTE, LOCAL_OFFSET_HOURS, MatchRule
from .asof import match_point, match_window
from .chunks import KEY, micros

WINDOW_LAYERS = ("local_rf", "local_rf_onset", "local_xgb")

# Measured rain rate in the next N minutes by UTC issue hour 0..23.
WINDOW_RATES = {
    5: (0.011284256, 0.043341709, 0.074825986, 0.054939516, 0.056678167, 0.082951654,
        0.071515892, 0.075183374, 0.079112123, 0.134380454, 0.216201999, 0.183925811,
        0.116118770, 0.113017751, 0.051656373, 0.038974359, 0.034197463, 0.054809843,
        0.050245767, 0.019596865, 0.061041293, 0.054802956, 0.017462165, 0.027764006),
    10: (0.011570248, 0.053265694, 0.082946636, 0.057099545, 0.068675889, 0.095584416,
         0.078105781, 0.085223789, 0.085204375, 0.161610268, 0.235325225, 0.196271362,
         0.126145553, 0.113622844, 0.051656373, 0.041968912, 0.038375973, 0.060572070,
         0.060406370, 0.023917995, 0.064613527, 0.056381660, 0.020551967, 0.018800813),
    30: (0.016345593, 0.091623037, 0.108468677, 0.065228557, 0.119238477, 0.132768362,
         0.102435978, 0.119949495, 0.105106888, 0.258559622, 0.276086957, 0.217185029,
         0.151129126, 0.114990969, 0.054988662, 0.051419389, 0.040276180, 0.081111741,
         0.100564972, 0.037679426, 0.039499671, 0.038612565, 0.000000000, 0.021544929),
}
# Measured point rain rate by local hour 0..23.
POINT_RATES = (
    0.083, 0.084, 0.081, 0.076, 0.036, 0.009, 0.036, 0.024, 0.034, 0.037, 0.030, 0.035,
    0.054, 0.058, 0.048, 0.055, 0.085, 0.145, 0.180, 0.162, 0.137, 0.114, 0.100, 0.097,
)


def hour_of(us: Column, shift_hours: int = 0) -> Column:
    """Hour of day of epoch micros, independent of the session zone."""
    shifted = us + shift_hours * HOUR
    return F.floor(F.pmod(shifted, F.lit(DAY)) / float(HOUR)).cast("int")


def is_window_layer(source: Column, layers=WINDOW_LAYERS) -> Column:
    return source.isin(*layers)


def climatology_rate(window: Column, issued_us: Column, valid_us: Column, lead: Column) -> Column:
    """Reference probability: window events by (lead, UTC issue hour), points by local valid hour.

    The tables are 24 entries each, so they travel as literals.
    """
    by_lead = F.lit(None).cast("double")
    for minutes, rates in WINDOW_RATES.items():
        table = F.array(*[F.lit(r) for r in rates])
        by_lead = F.when(lead == minutes, F.element_at(table, hour_of(issued_us) + 1)).otherwise(by_lead)
    point = F.element_at(F.array(*[F.lit(r) for r in POINT_RATES]), hour_of(valid_us, LOCAL_OFFSET_HOURS) + 1)
    return F.when(window, by_lead).otherwise(point)


def with_truth(forecasts: DataFrame, readings: DataFrame, layers=WINDOW_LAYERS, rule: MatchRule = MatchRule()) -> DataFrame:
    """Forecasts with ``actual`` (0/1/null) by the rule of their source and the climatology rate.

    ``layers`` names the sources whose claim covers the whole window.
    """
    window = is_window_layer(F.col("source_layer"), layers)
    graded = match_window(forecasts.filter(window), readings, rule).unionByName(
        match_point(forecasts.filter(~window), readings, rule=rule)
    )
    return graded.withColumn(
        "climatology",
        climatology_rate(window, F.unix_micros("issued_at"), F.unix_micros("valid_at"), F.col("lead_minutes")),
    )


def score(graded: DataFrame, by=(KEY, "source_layer", "lead_minutes")) -> DataFrame:
    """Brier score, climatology Brier (only if known for every row) and skill per group."""
    p, y, c = F.col("rain_prob"), F.col("actual").cast("double"), F.col("climatology")
    known = F.count(c) == F.count(F.lit(1))
    out = graded.filter(F.col("actual").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.when(known, F.avg((c - y) * (c - y))).alias("climatology_brier"),
        F.avg(p).alias("mean_predicted"),
        F.avg(y).alias("mean_observed"),
    )
    base = F.col("climatology_brier")
    return out.withColumn("skill_score", F.when(base > 0, 1.0 - F.col("brier_score") / base))


def score_state(graded: DataFrame, by: Sequence[str] = (KEY, "source_layer", "lead_minutes")) -> DataFrame:
    """What some forecasts contribute to the score of their group: counts and sums that can be merged."""
    p, y, c = F.col("rain_prob"), F.col("actual").cast("double"), F.col("climatology")
    return graded.filter(F.col("actual").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count(c).alias("with_climatology"), F.sum((p - y) * (p - y)).alias("brier"), F.sum((c - y) * (c - y)).alias("climatology"),
        F.sum(p).alias("predicted"), F.sum(y).alias("observed"))


def score_of_states(states: DataFrame, by: Sequence[str] = (KEY, "source_layer", "lead_minutes")) -> DataFrame:
    """The scores that ``score`` makes of the forecasts behind the states."""
    n = F.sum("rows")
    out = states.groupBy(*by).agg(
        n.alias("n"), (F.sum("brier") / n).alias("brier_score"), F.when(F.sum("with_climatology") == n, F.sum("climatology") / n).alias("climatology_brier"),
        (F.sum("predicted") / n).alias("mean_predicted"), (F.sum("observed") / n).alias("mean_observed"))
    base = F.col("climatology_brier")
    return out.withColumn("skill_score", F.when(base > 0, 1.0 - F.col("brier_score") / base))


def score_recent(
    forecasts: DataFrame, readings: DataFrame, now: Column, rule: MatchRule = MatchRule(), layers=WINDOW_LAYERS,
) -> DataFrame:
    """Score one trailing window of matured issue times; both scans are pruned by time."""
    now_us = F.unix_micros(now)
    end = now_us - rule.max_lead * MINUTE - micros(rule.point_tolerance)
    start = end - rule.lookback_days * DAY
    at = F.timestamp_micros
    # The columns themselves are compared, so that literal bounds reach the scans.
    fresh = forecasts.filter((F.col("issued_at") >= at(start)) & (F.col("issued_at") < at(end)) & (F.col("valid_at") <= now))
    near = readings.filter((F.col("ts") >= at(start - 5 * MINUTE)) & (F.col("ts") < now))
    as_of = F.to_date(F.timestamp_micros(now_us + LOCAL_OFFSET_HOURS * HOUR))
    return score(with_truth(fresh, near, layers, rule)).withColumn("as_of_date", as_of)


def storable(scores: DataFrame) -> DataFrame:
    """Only groups with a measured climatology are kept in the score log."""
    return scores.filter(F.col("climatology_brier").isNotNull())
