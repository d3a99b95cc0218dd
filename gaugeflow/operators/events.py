"""Forecast audit by events and alert episodes, for a whole grid of thresholds at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import AUDIT_GAPS, EPISODE_THRESHOLDS, HOUR, LabelRule
from .chunks import CHUNK, CORE, KEY, US, bucket, core_only, micros, ordinal, running_total, spread
from .lineage import cut
from .labels import dry_flags, future_onset, future_rain, label_reach, onset_flag, segment_window
from .quantiles import exact_quantiles
from .segments import FILLED, SEG, mark_segments


@dataclass(frozen=True)
class AuditRule:
    horizon: int = 30
    dry_rows: int = 60
    cooldown_minutes: float = 30.0
    scope: str = "dry_now"  # or dry_60m
    target: str = "rain_window"  # or rain_onset
    confirm_streak: int = 1

    def __post_init__(self):
        if self.horizon < 1 or self.dry_rows < 1 or self.confirm_streak < 1 or self.cooldown_minutes <= 0:
            raise ValueError("horizon, dry_rows, confirm_streak and cooldown must be positive")
        if self.scope not in ("dry_now", "dry_60m") or self.target not in ("rain_window", "rain_onset"):
            raise ValueError("unknown scope or target")


def _guard(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def audit_frame(history: DataFrame, predictions: DataFrame, rule: AuditRule) -> DataFrame:
    """Observation rows with everything the audit needs, from one chunk shuffle.

    ``_score`` is the largest threshold at which the row is a confirmed alert:
    the smallest probability over the confirming run.  With it, alerts at any
    threshold are a comparison and the grid never multiplies the data rows.
    """
    labels = LabelRule(dry_rows=rule.dry_rows)
    h, cool = rule.horizon, rule.cooldown_minutes * 60
    # Farthest look back: dry cohort and streak of the first row of an onset's horizon,
    # or of an alert one cooldown ago.
    before = (h + max(rule.dry_rows, 60) + rule.confirm_streak + 1) * AUDIT_GAPS.high + cool
    after = label_reach(h, labels) + cool + 2 * AUDIT_GAPS.high
    p, y = F.col("probability"), F.col("observed")
    # Grouped by what the join below is dealt by, so the check costs no further shuffle.
    dry = F.col(rule.scope) if rule.scope in predictions.columns else F.lit(None).cast("boolean")
    saved = predictions.groupBy(KEY, "ts").agg(
        F.count(F.lit(1)).alias("_times"), F.first(p).alias("probability"), F.first(y).alias("observed"), F.first(dry.cast("boolean")).alias("_dry_said"))
    saved = saved.select(
        KEY, "ts",
        _guard(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), "probability must be in [0, 1]", p).alias("probability"),
        _guard(y.isNull() | ~y.isin(0, 1), "observed must be binary", y.cast("double")).alias("observed"),
        (_guard(F.col("_times") > 1, "repeated prediction", F.lit(1.0)) == 1.0).alias("_has"), "_dry_said",
    )
    keep = [c for c in (KEY, "ts", "rain_flag", FILLED) if c in history.columns]
    df = history.select(*keep).join(saved, [KEY, "ts"], "left")
    df = mark_segments(spread(df, before, after), AUDIT_GAPS)
    w = segment_window()
    df = df.withColumn("_new_rain", onset_flag(df, labels, check_filled_past=False))
    if rule.target == "rain_onset":
        df = df.withColumn("_onset_label", onset_flag(df, labels))
        label = future_onset(df, h, "_onset_label", labels)
    else:
        label = future_rain(df, h, labels)
    df = df.withColumns({"_future": label, "_future_end": F.lead(US, h).over(w), **dry_flags(df)})
    usable = F.coalesce(F.col("_has") & F.col("_future").isNotNull(), F.lit(False))
    clash = F.col(CORE) & usable & (F.col("observed") != F.col("_future"))
    dry_clash = F.col(CORE) & usable & (F.col("_dry_said") != F.col(rule.scope))
    checked = _guard(dry_clash, "saved dry flags disagree with the observation history", usable.cast("double"))
    df = df.withColumn("_usable", _guard(clash, "saved labels disagree with the observation history", checked).cast("int"))
    raw = F.when((F.col("_usable") == 1) & F.col(rule.scope), F.col("probability"))
    df = df.withColumn("_raw", raw)
    run = w.rowsBetween(-(rule.confirm_streak - 1), 0)
    score = F.when(F.col("_usable") == 1, F.when(F.count("_raw").over(run) == rule.confirm_streak, F.min("_raw").over(run)))
    opens = (F.col("_usable") == 1) & (F.coalesce(F.lag("_usable").over(w), F.lit(0)) == 0)
    closes = (F.col("_usable") == 1) & (F.coalesce(F.lead("_usable").over(w), F.lit(0)) == 0)
    df = df.withColumns({"_score": score, "_opens": opens, "_closes": closes})
    # Nearest block edges, looked for no further than the cooldown (strictly inside it).
    cool_us = micros(cool)
    back, ahead = w.rangeBetween(-(cool_us - 1), 0), w.rangeBetween(0, cool_us - 1)
    wide = w.rangeBetween(-cool_us, 0)
    prior = w.rowsBetween(-h, -1)
    return df.withColumns({
        "_left": F.max(F.col("_opens").cast("int")).over(back) == 1,
        "_right": F.max(F.col("_closes").cast("int")).over(ahead) == 1,
        "_block_us": F.max(F.when(F.col("_opens"), F.col(US))).over(wide),
        "_evaluable": (F.sum("_usable").over(prior) == h) & (F.count("_usable").over(prior) == h),
        "_prior_best": F.max("_score").over(prior),
        "_prior_us": F.lag(US, h).over(w),
    })


def _levels(thresholds: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(t)) for t in thresholds])


def alert_rows(frame: DataFrame, thresholds: Sequence[float], rule: AuditRule) -> DataFrame:
    """Confirmed alerts per threshold with their station-wide episode number."""
    hot = frame.filter(F.col("_score") >= min(thresholds))
    hot = hot.withColumn("threshold", F.explode(F.filter(_levels(thresholds), lambda t: t <= F.col("_score"))))
    w = Window.partitionBy(KEY, CHUNK, SEG, "threshold").orderBy(US)
    prev = F.lag(US).over(w)
    new = prev.isNull() | (F.col(US) - prev > micros(rule.cooldown_minutes * 60)) | F.coalesce(F.col("_block_us") > prev, F.lit(False))
    hot = core_only(hot.withColumn("_new", new.cast("int")))
    return running_total(hot, [KEY, "threshold"], [US], F.col("_new"), "episode_id")


def episodes_of(alerts: DataFrame) -> DataFrame:
    """One row per alert episode."""
    return alerts.groupBy(KEY, "threshold", "episode_id").agg(
        F.min(US).alias("first_alert_us"), F.max(US).alias("last_alert_us"), F.count(F.lit(1)).alias("alert_rows"),
        F.min_by("_left", US).alias("left_censored"), F.max_by("_right", US).alias("right_censored"),
        (F.max("_future") > 0).alias("observed_rain"),
    ).withColumn("complete", ~(F.col("left_censored") | F.col("right_censored"))).withColumn("false_alarm", ~F.col("observed_rain"))


def station_rows(frame: DataFrame) -> DataFrame:
    """Per station: usable rows and the span they can speak about."""
    usable = F.col("_usable") == 1
    return core_only(frame).groupBy(KEY).agg(
        F.sum("_usable").cast("long").alias("usable_forecast_rows"),
        F.min(F.when(usable, F.col(US))).alias("_from"), F.max(F.when(usable, F.col("_future_end"))).alias("_to"))


def onset_rows(marks: DataFrame, stations: DataFrame) -> DataFrame:
    """New-rain onsets inside the span the forecasts can speak about, numbered per station."""
    onsets = core_only(marks).filter("_new_rain = 1").select(KEY, CHUNK, US, "_evaluable", "_prior_best", "_prior_us")
    onsets = onsets.join(stations, KEY).filter((F.col(US) > F.col("_from")) & (F.col(US) <= F.col("_to")))
    onsets = ordinal(onsets, [KEY], [US], "event_id")
    return onsets.select(
        KEY, "event_id", F.col(US).alias("onset_us"), F.coalesce("_evaluable", F.lit(False)).alias("evaluable"),
        "_prior_best", "_prior_us")


def match_events(onsets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts among the ``horizon`` rows before each evaluable onset.

    The range join goes through hour buckets; one event touches at most the
    hours its horizon spans.  Returns (event, threshold) pairs with the first
    alert and the episodes involved.
    """
    e = onsets.filter("evaluable").withColumn(
        "_hour", F.explode(F.sequence(bucket(F.col("_prior_us"), HOUR), bucket(F.col("onset_us"), HOUR))))
    a = alerts.select(KEY, "threshold", "episode_id", F.col(US).alias("_alert_us"), bucket(F.col(US), HOUR).alias("_hour"))
    hits = e.join(a, [KEY, "_hour"]).filter(
        (F.col("_alert_us") >= F.col("_prior_us")) & (F.col("_alert_us") < F.col("onset_us")))
    return hits.groupBy(KEY, "event_id", "onset_us", "threshold").agg(
        F.min("_alert_us").alias("first_matching_alert_us"),
        F.sort_array(F.collect_set("episode_id")).alias("matching_episode_ids"))


def audit(
    history: DataFrame, predictions: DataFrame, thresholds: Sequence[float], rule: AuditRule = AuditRule()
) -> dict[str, DataFrame]:
    """Events, episodes and summary per (station, threshold) for one horizon."""
    # The frame is computed once: usable rows, possible alerts and onsets are
    # stored narrow, and every table below is built from them.
    frame = audit_frame(history, predictions, rule)
    mark = (F.col("_score") >= min(thresholds)) | (F.col(CORE) & (F.col("_new_rain") == 1))
    frame = frame.withColumn("_mark", F.coalesce(mark, F.lit(False))).filter(F.col("_mark") | (F.col(CORE) & (F.col("_usable") == 1)))
    frame = cut(frame.select(
        KEY, CHUNK, SEG, US, CORE, "_score", "_left", "_right", "_block_us", "_future", "_new_rain",
        "_evaluable", "_prior_best", "_prior_us", "_usable", "_future_end", "_mark"), "frame")
    marks = frame.filter("_mark")
    stations = cut(station_rows(frame), "stations")
    alerts = cut(alert_rows(marks, thresholds, rule).select(
        KEY, "threshold", "episode_id", US, "_left", "_right", "_future"), "alerts")
    onsets = cut(onset_rows(marks, stations), "onsets")
    matches = cut(match_events(onsets, alerts), "matches")
    grid = F.explode(_levels(thresholds)).alias("threshold")
    events = onsets.select("*", grid).join(matches.drop("onset_us"), [KEY, "event_id", "threshold"], "left")
    lead = (F.col("onset_us") - F.col("first_matching_alert_us")) / 60e6
    events = events.select(
        KEY, "threshold", "event_id", "onset_us", "evaluable",
        F.col("first_matching_alert_us").isNotNull().alias("detected"), "first_matching_alert_us",
        lead.alias("lead_minutes"),
        F.coalesce("matching_episode_ids", F.array().cast("array<bigint>")).alias("matching_episode_ids"))
    matched = matches.select(KEY, "threshold", "event_id", F.explode("matching_episode_ids").alias("episode_id"))
    matched = matched.groupBy(KEY, "threshold", "episode_id").agg(F.sort_array(F.collect_set("event_id")).alias("matched_event_ids"))
    episodes = episodes_of(alerts).join(matched, [KEY, "threshold", "episode_id"], "left").withColumn(
        "matched_event_ids", F.coalesce("matched_event_ids", F.array().cast("array<bigint>")))
    return {"events": events, "episodes": episodes, "summary": summarise(stations, events, episodes, predictions, thresholds, rule)}


def summarise(stations, events, episodes, predictions, thresholds, rule: AuditRule) -> DataFrame:
    """Recall, false-alarm ratio and lead times per (station, threshold)."""
    key = [KEY, "threshold"]
    rows = stations.select(KEY, "usable_forecast_rows")
    given = predictions.groupBy(KEY).agg(F.count(F.lit(1)).alias("input_forecast_rows"))
    base = given.join(rows, KEY, "left").withColumn("usable_forecast_rows", F.coalesce("usable_forecast_rows", F.lit(0).cast("long")))
    base = base.select("*", F.explode(_levels(thresholds)).alias("threshold"))
    ev = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("onsets_in_span"), F.count(F.when(F.col("evaluable"), 1)).alias("evaluable_onsets"),
        F.count(F.when(F.col("detected"), 1)).alias("detected_onsets"))
    full = F.col("complete")
    ep = episodes.groupBy(*key).agg(
        F.sum("alert_rows").alias("alert_rows"), F.count(F.lit(1)).alias("alert_episodes"),
        F.count(F.when(full, 1)).alias("complete_alert_episodes"),
        F.count(F.when(full & F.col("false_alarm"), 1)).alias("false_alert_episodes"),
        F.count(F.when(full & F.col("observed_rain") & (F.size("matched_event_ids") == 0), 1)).alias("rain_episodes_without_evaluable_new_onset"))
    leads = exact_quantiles(events.filter("detected"), key, "lead_minutes", (0.0, 0.25, 0.5, 0.75, 1.0)).select(*key, "q")
    out = base.join(ev, key, "left").join(ep, key, "left").join(leads, key, "left")
    counts = [
        "onsets_in_span", "evaluable_onsets", "detected_onsets", "alert_rows", "alert_episodes",
        "complete_alert_episodes", "false_alert_episodes", "rain_episodes_without_evaluable_new_onset",
    ]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    recall = F.when(F.col("evaluable_onsets") > 0, F.col("detected_onsets") / F.col("evaluable_onsets"))
    ratio = F.when(F.col("complete_alert_episodes") > 0, F.col("false_alert_episodes") / F.col("complete_alert_episodes"))
    return out.select(
        KEY, "threshold", F.lit(rule.horizon).alias("horizon"), "input_forecast_rows", "usable_forecast_rows",
        (F.col("input_forecast_rows") - F.col("usable_forecast_rows")).alias("excluded_forecast_rows"), *counts,
        (F.col("alert_episodes") - F.col("complete_alert_episodes")).alias("censored_alert_episodes"),
        recall.alias("onset_recall"), ratio.alias("false_alarm_ratio"),
        *[F.element_at("q", i + 1).alias(f"lead_{n}") for i, n in enumerate(("min", "p25", "median", "p75", "max"))],
    )


def choose_threshold(
    summary: DataFrame, by: Sequence[str] = (KEY, "horizon"), max_false_ratio: float = 0.20, max_false: int | None = None
) -> DataFrame:
    """Highest recall within the false-episode budget; 1.0 where no alerting threshold qualifies."""
    by = list(by)
    safe = F.coalesce("false_alarm_ratio", F.lit(0.0)) <= max_false_ratio
    if max_false is not None:
        safe = safe & (F.col("false_alert_episodes") <= max_false)
    safe = safe & (F.col("alert_rows") > 0) & (F.col("complete_alert_episodes") > 0)
    # Missing recall or ratio sorts last, as in a plain table sort.
    order = F.struct(
        F.col("onset_recall").isNull(), -F.coalesce("onset_recall", F.lit(0.0)), F.col("false_alarm_ratio").isNull(),
        F.coalesce("false_alarm_ratio", F.lit(0.0)), F.col("alert_rows"), F.col("threshold"))
    best = F.struct("threshold", "onset_recall", "false_alarm_ratio", "alert_rows")
    out = summary.groupBy(*by).agg(F.min_by(F.when(safe, best), F.when(safe, order)).alias("b"))
    return out.select(
        *by, F.coalesce("b.threshold", F.lit(1.0)).alias("threshold"),
        F.when(F.col("b").isNotNull(), "max_onset_recall_under_false_episode_budget")
        .otherwise("no_nontrivial_validation_threshold_meets_episode_budget").alias("reason"),
        F.when(F.col("b").isNotNull(), F.coalesce("b.onset_recall", F.lit(0.0))).alias("onset_recall"),
        F.when(F.col("b").isNotNull(), F.coalesce("b.false_alarm_ratio", F.lit(0.0))).alias("false_alarm_ratio"),
        F.col("b.alert_rows").alias("alert_rows"))
