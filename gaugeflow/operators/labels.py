"""Future-event labels, dry cohorts, chronological splits, sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import MINUTE, RAIN_THRESHOLD, SECOND, Cadence, FEATURE_GAPS, GapRule, LabelRule, SplitRule
from .chunks import CHUNK, KEY, US, carry, core_only, cut_points, micros, running_total, spread, with_chunk
from .lineage import cut
from .segments import FILLED, SEG, drop_bursts, mark_segments, repaired_chunks


def segment_window() -> Window:
    return Window.partitionBy(KEY, CHUNK, SEG).orderBy(US)


def future_max(value: Column, rows: int) -> Column:
    """Maximum over the next ``rows`` rows of the segment, null if fewer remain."""
    ahead = segment_window().rowsBetween(1, rows)
    return F.when(F.count(value).over(ahead) == rows, F.max(value).over(ahead))


def past_max(value: Column, rows: int) -> Column:
    """Maximum over the previous ``rows`` rows (current excluded), null if fewer exist."""
    behind = segment_window().rowsBetween(-rows, -1)
    return F.when(F.count(value).over(behind) == rows, F.max(value).over(behind))


def _filled(df: DataFrame) -> Column:
    return F.coalesce(F.col(FILLED), F.lit(0.0)) if FILLED in df.columns else F.lit(0.0)


def _window_complete(filled: Column, rows: int, rule: LabelRule) -> Column:
    """The next ``rows`` rows span that many minutes and hold no repaired row."""
    elapsed = F.lead(US, rows).over(segment_window()) - F.col(US)
    on_time = F.abs(elapsed - rows * MINUTE) <= micros(rule.jitter)
    return on_time & (F.coalesce(future_max(filled, rows), F.lit(0.0)) <= 0)


def future_rain(df: DataFrame, rows: int, rule: LabelRule = LabelRule()) -> Column:
    """Any rain in the next ``rows`` samples (0/1); null without full real coverage."""
    wettest = future_max(F.col("rain_flag"), rows)
    return F.when(_window_complete(_filled(df), rows, rule) & wettest.isNotNull(), (wettest > RAIN_THRESHOLD).cast("int"))


def onset_flag(df: DataFrame, rule: LabelRule = LabelRule(), check_filled_past: bool = True) -> Column:
    """1 on the first wet real sample after a full dry antecedent; too little past is 0."""
    filled = _filled(df)
    elapsed = F.col(US) - F.lag(US, rule.dry_rows).over(segment_window())
    ok = (
        (F.col("rain_flag") > RAIN_THRESHOLD)
        & (filled <= 0)
        & (past_max(F.col("rain_flag"), rule.dry_rows) <= RAIN_THRESHOLD)
        & (F.abs(elapsed - rule.dry_rows * MINUTE) <= micros(rule.jitter))
    )
    if check_filled_past:
        ok = ok & (F.coalesce(past_max(filled, rule.dry_rows), F.lit(0.0)) <= 0)
    return F.coalesce(ok, F.lit(False)).cast("int")


def future_onset(df: DataFrame, rows: int, onset: str, rule: LabelRule = LabelRule()) -> Column:
    """A new onset (flag column ``onset``) within the next ``rows`` samples."""
    return F.when(_window_complete(_filled(df), rows, rule), future_max(F.col(onset), rows))


def label_reach(rows: int, rule: LabelRule = LabelRule()) -> float:
    """Seconds of future a label can use: beyond it the elapsed check fails anyway."""
    return rows * 60 + rule.jitter + 1


def future_rain_rows(
    readings: DataFrame, horizons: int | Sequence[int], rule: LabelRule = LabelRule(),
    cadence: Cadence = Cadence(), gaps: GapRule = FEATURE_GAPS,
) -> DataFrame:
    """Label burst-free, unfilled readings, all horizons from one shuffle.

    Adds ``future_rain`` for one horizon, ``future_rain_<h>m`` for several.
    """
    named = {"future_rain": horizons} if isinstance(horizons, int) else {f"future_rain_{h}m": h for h in horizons}
    df = spread(readings, gaps.high, label_reach(max(named.values()), rule) + cadence.burst_max)
    df = mark_segments(drop_bursts(df, cadence), gaps)
    df = df.withColumns({c: future_rain(df, h, rule) for c, h in named.items()})
    return core_only(df).drop(US, CHUNK, SEG, "_start")


def label_rows(readings: DataFrame, horizons, rule: LabelRule = LabelRule(), onset: bool = True) -> DataFrame:
    """Repaired readings with ``rain_<h>m``/``onset_<h>m`` labels, one shuffle for all horizons."""
    h_max = max(horizons)
    back = rule.dry_rows * 60 + rule.jitter + 1
    df = repaired_chunks(readings, before=back, after=label_reach(h_max, rule))
    df = df.withColumn("onset", onset_flag(df, rule))
    named = {f"rain_{h}m": future_rain(df, h, rule) for h in horizons}
    if onset:
        named |= {f"onset_{h}m": future_onset(df, h, "onset", rule) for h in horizons}
    return core_only(df.withColumns(named)).drop(US, CHUNK, SEG, "_start")


def dry_flags(df: DataFrame, rows: int = 60) -> dict[str, Column]:
    """Dry now, and dry over the last ``rows`` samples including now (chunked frame)."""
    last = segment_window().rowsBetween(-(rows - 1), 0)
    full = F.when(F.count("rain_flag").over(last) == rows, F.max("rain_flag").over(last))
    now = F.col("rain_flag") <= RAIN_THRESHOLD
    return {"dry_now": now, "dry_60m": now & F.coalesce(full <= RAIN_THRESHOLD, F.lit(False))}


def split(df: DataFrame, horizon: int, rule: SplitRule = SplitRule()) -> DataFrame:
    """Chronological parts per station, purging rows whose label crosses into the next part.

    The times at which the parts start are found first, from station and time
    alone; the (wide) rows are then labelled by comparing times.  Stations with
    fewer than ``min_rows`` rows get the part ``too_short``.
    """
    ranks = {f"_next{i}": (lambda n, f=f: F.floor(n * F.lit(f))) for i, f in enumerate(rule.fractions)}
    starts = cut(cut_points(df, [KEY], ["ts"], ranks), "starts")
    df = df.join(starts, KEY)
    us = F.unix_micros("ts")
    part, limit = F.lit(rule.names[-1]), F.lit(None).cast("long")
    for i in reversed(range(len(rule.fractions))):
        start = F.unix_micros(f"_next{i}.ts")
        part = F.when(us < start, rule.names[i]).otherwise(part)
        limit = F.when(us < start, start).otherwise(limit)
    label_end = us + horizon * MINUTE + micros(rule.jitter)
    part = F.when(F.col("_total") < rule.min_rows, "too_short").otherwise(part)
    return (
        df.withColumns({"part": part, "_limit": limit})
        .filter(F.col("_limit").isNull() | (label_end < F.col("_limit")))
        .drop("_total", "_limit", *ranks)
    )


def onset_weights(df: DataFrame, target: str = "target", boost: float = 1.5) -> DataFrame:
    """Sample weights: equal mass per positive episode, boosted humid or darkening negatives.

    An episode is a run of consecutive positive rows of a station.
    """
    positive = F.coalesce(F.col(target) > 0.5, F.lit(False))
    rows = with_chunk(df.select(KEY, "ts", positive.cast("int").alias("_pos")))
    rows = carry(
        rows, [KEY],
        [F.max_by("_pos", "ts").alias("_last")],
        {"_before": lambda w: F.coalesce(F.lag("_last").over(w), F.lit(0))},
    )
    w = Window.partitionBy(KEY, CHUNK).orderBy("ts")
    first = F.coalesce(F.lag("_pos").over(w), F.col("_before")) == 0
    # Only the (rare) positive rows are numbered and sized.
    hot = cut(rows.withColumn("_first", first.cast("int")).filter("_pos = 1").select(KEY, CHUNK, "ts", "_first"), "positives")
    hot = running_total(hot, [KEY], ["ts"], F.col("_first"), "_episode")
    sizes = hot.groupBy(KEY, "_episode").agg(F.count(F.lit(1)).alias("_size"))
    mass = sizes.groupBy(KEY).agg((F.sum("_size") / F.count(F.lit(1))).alias("_mean"))
    share = hot.join(sizes.join(mass, KEY), [KEY, "_episode"]).select(KEY, "ts", (F.col("_mean") / F.col("_size")).alias("_share"))
    hard = ~positive
    if "humidity" in df.columns:
        hard = hard & (F.coalesce(F.col("humidity"), F.lit(0.0)) >= 85.0)
    if "light_slope_30m" in df.columns:
        hard = hard & (F.coalesce(F.col("light_slope_30m"), F.lit(0.0)) < 0.0)
    weight = F.when(positive, F.col("_share")).when(hard, boost).otherwise(1.0)
    return df.join(share, [KEY, "ts"], "left").withColumn("weight", weight).drop("_share")


def common_rows(df: DataFrame, horizons, features=(), kind: str = "rain") -> DataFrame:
    """Real rows with every feature and a valid label at every horizon."""
    needed = [*features, *[f"{kind}_{h}m" for h in horizons]]
    return df.filter(F.coalesce(F.col(FILLED), F.lit(0.0)) <= 0).dropna(subset=needed)


def filter_counts(df: DataFrame, horizons, kind: str = "rain") -> DataFrame:
    """Rows, repaired rows, labelled rows per horizon and rows usable at all horizons."""
    synthetic = F.coalesce(F.col(FILLED), F.lit(0.0)) > 0
    common = ~synthetic
    for h in horizons:
        common = common & F.col(f"{kind}_{h}m").isNotNull()
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(synthetic, 1)).alias("synthetic"),
        *[F.count(f"{kind}_{h}m").alias(f"valid_{h}m") for h in horizons],
        F.count(F.when(common, 1)).alias("common"),
    )
