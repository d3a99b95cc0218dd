"""Rain events closed by a run of dry samples, and the remaining-duration estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..policy import RAIN_STOP_GAPS, RAIN_THRESHOLD, GapRule, RainStopPolicy
from .chunks import CHUNK, KEY, US, core_only, running_total, spread
from .lineage import cut
from .labels import segment_window
from .quantiles import exact_quantiles
from .segments import mark_segments


def _marked(readings: DataFrame, policy: RainStopPolicy, gaps: GapRule) -> DataFrame:
    """Core rows with segment starts and event boundary marks; every mark is a local decision."""
    k = policy.dry_rows
    reach = (k + 1) * gaps.high
    df = readings.select(KEY, "ts", "rain_flag").filter(F.col("rain_flag").isNotNull() & ~F.isnan("rain_flag"))
    df = mark_segments(spread(df, reach, reach), gaps)
    df = df.withColumn("_wet", (F.col("rain_flag") > RAIN_THRESHOLD).cast("int"))
    w = segment_window()
    before = F.coalesce(F.max("_wet").over(w.rowsBetween(-k, -1)), F.lit(0))
    after = F.coalesce(F.max("_wet").over(w.rowsBetween(1, k)), F.lit(0))
    return core_only(df.withColumns({
        "_opens": (F.col("_wet") == 1) & (before == 0),
        "_closes": (F.col("_wet") == 1) & (after == 0),
        "_complete": F.count("_wet").over(w.rowsBetween(1, k)) == k,
        "_stop": F.lead(US).over(w),
    }))


def _events(marked: DataFrame) -> DataFrame:
    marks = marked.filter("_opens or _closes").select(KEY, CHUNK, US, "_opens", "_closes", "_complete", "_stop")
    marks = running_total(cut(marks, "marks"), [KEY], [US], F.col("_opens"), "event_no")
    events = marks.groupBy(KEY, "event_no").agg(
        F.min(F.when(F.col("_opens"), F.col(US))).alias("start_us"),
        F.max(F.when(F.col("_closes"), F.col(US))).alias("last_wet_us"),
        F.max(F.when(F.col("_closes") & F.col("_complete"), F.col("_stop"))).alias("stop_us"),
    )
    minutes = rounded((F.col("stop_us") - F.col("start_us")) / 60e6, 2)
    return events.withColumns({"complete": F.col("stop_us").isNotNull(), "duration_minutes": minutes})


def rain_events(readings: DataFrame, policy: RainStopPolicy = RainStopPolicy(), gaps: GapRule = RAIN_STOP_GAPS) -> DataFrame:
    """One row per rain event: start, confirmed stop (null if censored by a gap), completeness, duration.

    A wet row starts an event if none of the ``dry_rows`` rows before it in
    the segment is wet, and ends one if the ``dry_rows`` rows after it are dry
    (complete) or the segment stops first (censored).  Only these marks are
    numbered and grouped.
    """
    return _events(_marked(readings, policy, gaps))


def rain_stop(
    readings: DataFrame, now: Column, policy: RainStopPolicy = RainStopPolicy(), gaps: GapRule = RAIN_STOP_GAPS
) -> DataFrame:
    """Live rain-stop status of every station at one ``now``."""
    return rain_stop_at(readings, readings.select(KEY).distinct().withColumn("now", now), policy, gaps)


def rain_stop_at(
    readings: DataFrame, clock: DataFrame, policy: RainStopPolicy = RainStopPolicy(), gaps: GapRule = RAIN_STOP_GAPS
) -> DataFrame:
    """Per station: is it raining, since when, and how long it may still rain.

    ``clock`` gives the time ``now`` at which each station is judged.

    Durations of complete events give the 20/50/80 percent points; the
    ladder of statuses refuses to estimate from stale, pending or thin data.
    """
    marked = _marked(readings, policy, gaps)
    events = _events(marked)
    latest = marked.groupBy(KEY).agg(
        F.max("ts").alias("latest"), (F.max_by("rain_flag", "ts") > RAIN_THRESHOLD).alias("wet"),
        F.max(F.when(F.col("_start") == 1, F.col(US))).alias("_segment_us"))
    done = exact_quantiles(events.filter("complete"), [KEY], "duration_minutes", (0.2, 0.5, 0.8))
    counts = events.groupBy(KEY).agg(
        F.count(F.when(F.col("complete"), 1)).alias("completed_events"),
        F.count(F.when(~F.col("complete"), 1)).alias("censored_events"),
        F.max(F.struct("start_us", "last_wet_us", "complete")).alias("_last"),
    )
    df = latest.join(clock.select(KEY, "now"), KEY).join(counts, KEY, "left").join(done.select(KEY, "q"), KEY, "left")
    latest_us = F.unix_micros("latest")
    stale = F.unix_micros("now") - latest_us > int(policy.stale * 1e6)
    # An open event describes the live state only inside the newest segment.
    open_now = F.coalesce(~F.col("_last.complete") & (F.col("_last.start_us") >= F.col("_segment_us")), F.lit(False))
    pending = ~F.col("wet") & open_now
    raining = F.col("wet") & open_now
    n = F.coalesce("completed_events", F.lit(0))
    status = (
        F.when(stale, "latest_observation_stale").when(pending, "stop_not_confirmed").when(~raining, "not_raining")
        .when(n < policy.min_events, "insufficient_completed_events").otherwise("experimental")
    )
    elapsed = F.greatest((latest_us - F.col("_last.start_us")) / 60e6, F.lit(0.0))
    low, mid, high = (F.element_at("q", i) for i in (1, 2, 3))
    remaining = F.greatest(mid - elapsed, F.lit(0.0))
    ok = F.col("status") == "experimental"
    return df.withColumn("status", status).select(
        KEY, "latest", "status", n.alias("completed_events"),
        F.coalesce("censored_events", F.lit(0)).alias("censored_events"),
        F.when(F.col("status").isin("experimental", "insufficient_completed_events"), rounded(elapsed, 2)).alias("elapsed_minutes"),
        F.when(ok, rounded(F.greatest(low - elapsed, F.lit(0.0)), 1)).alias("remaining_lower"),
        F.when(ok, rounded(remaining, 1)).alias("remaining_median"),
        F.when(ok, rounded(F.greatest(remaining, high - elapsed), 1)).alias("remaining_upper"),
        F.when(ok, rounded(low, 1)).alias("p20"), F.when(ok, rounded(mid, 1)).alias("p50"), F.when(ok, rounded(high, 1)).alias("p80"),
    )
