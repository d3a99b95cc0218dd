"""Forecast revisions between consecutive issues of a station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..policy import RevisionPolicy
from .alerts import cooldown_gate
from .chunks import KEY
from .summaries import first_wet_hour


def compare_issues(hourly: DataFrame, policy: RevisionPolicy = RevisionPolicy(), issue: str = "issued_hour") -> DataFrame:
    """Each issue against the one before it, on equal valid times only.

    Input: station, issue, ``valid_at``, ``rain_prob``, ``temp``, and if known
    ``fetched_at`` (when the provider's data came) and ``model_version`` of the
    issue, which tell whether either differs from the issue before.  The issue
    list is one row per issue; hours meet through an equi-join on
    (station, previous issue, valid time).
    """
    facts = {"fetched_at": "provider_updated", "model_version": "model_or_postprocessing_changed"}
    given = [c for c in facts if c in hourly.columns]
    issues = hourly.groupBy(KEY, issue).agg(F.max(F.lit(True)).alias("_any"), *[F.max(c).alias(c) for c in given]).drop("_any")
    in_turn = Window.partitionBy(KEY).orderBy(issue)
    changed = {facts[c]: ~F.col(c).eqNullSafe(F.lag(c).over(in_turn)) for c in given}
    pairs = issues.withColumns({"previous_issue": F.lag(issue).over(in_turn)} | changed).drop(*given)
    now = hourly.join(pairs, [KEY, issue])
    old = hourly.select(KEY, F.col(issue).alias("previous_issue"), "valid_at", F.col("rain_prob").alias("_p"), F.col("temp").alias("_t"))
    deltas = now.join(old, [KEY, "previous_issue", "valid_at"]).groupBy(KEY, issue).agg(
        F.count(F.lit(1)).alias("common_valid_times"),
        F.max(F.abs(F.col("rain_prob") - F.col("_p"))).alias("_dp"), F.max(F.abs(F.col("temp") - F.col("_t"))).alias("_dt"))
    first = first_wet_hour(hourly, [KEY, issue], threshold=policy.rain_window)
    df = (
        pairs.join(deltas, [KEY, issue], "left").join(first, [KEY, issue], "left")
        .join(first.select(KEY, F.col(issue).alias("previous_issue"), F.col("first_wet").alias("_old_wet")), [KEY, "previous_issue"], "left")
    )
    dp, dt = F.coalesce("_dp", F.lit(0.0)), F.coalesce("_dt", F.lit(0.0))
    shift = (F.unix_micros("first_wet") - F.unix_micros("_old_wet")) / 60e6
    reasons = F.array_compact(F.array(
        F.when(dp >= policy.probability_points, "rain_probability"),
        F.when(F.abs(shift) >= policy.shift_minutes, "rain_window_shift"),
        F.when(dt >= policy.temperature, "temperature"),
    ))
    comparable = F.col("common_valid_times").isNotNull()
    missing = F.when(F.col("previous_issue").isNull(), F.array(F.lit("missing_snapshot"))).otherwise(F.array(F.lit("no_common_valid_times")))
    status = F.when(~comparable, "not_comparable").when(F.size(reasons) > 0, "changed").otherwise("unchanged")
    return df.select(
        KEY, issue, "previous_issue", status.alias("status"), F.coalesce("common_valid_times", F.lit(0)).alias("common_valid_times"),
        F.when(comparable, rounded(dp, 2)).alias("max_rain_probability_delta_points"),
        F.when(comparable, rounded(dt, 2)).alias("max_temperature_delta_c"),
        F.when(comparable, rounded(shift, 1)).alias("rain_window_shift_minutes"),
        F.when(comparable, F.col("_old_wet")).alias("previous_rain_window_start"),
        F.when(comparable, F.col("first_wet")).alias("current_rain_window_start"),
        *[F.when(comparable, F.col(facts[c])).alias(facts[c]) for c in given],
        F.when(comparable, reasons).otherwise(missing).alias("reasons"))


def revision_notices(revisions: DataFrame, policy: RevisionPolicy = RevisionPolicy(), issue: str = "issued_hour") -> DataFrame:
    """Changed revisions that may be announced, at most one per cooldown."""
    changed = revisions.filter("status = 'changed'").select(
        KEY, F.col(issue).alias("ts"), F.lit(0).alias("seq"), F.lit("revision").alias("kind"))
    return cooldown_gate(changed, policy.cooldown)


def snapshot_fingerprint(df: DataFrame, by: Sequence[str], order: str, doubles: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """Short hash of each snapshot (a few dozen rows).

    The rows by time, joined by ``|``; a row's time in microseconds and values,
    joined by ``:``, doubles with six decimals, ``null`` for none.
    """
    def shown(text: Column) -> Column:
        return F.coalesce(text, F.lit("null"))

    values = [F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))) for c in doubles] + [F.col(c).cast("string") for c in others]
    row = F.struct(F.unix_micros(order).alias("_o"), F.concat_ws(":", F.unix_micros(order).cast("string"), *map(shown, values)).alias("_t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["_t"]), "|")
    return df.groupBy(*by).agg(F.substring(F.sha2(text, 256), 1, 20).alias("snapshot_id"))


#: A string, a number, or anything between them, in JSON text.
_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def canonical(value: Column) -> Column:
    """One text for equal contents, whatever the nesting and the order of keys.

    Struct, map, array or variant; as JSON with sorted keys, nulls kept, and every
    number with six decimals, so that 1 and 1.0 are equal.
    """
    text = F.to_json(F.parse_json(F.to_json(value, {"ignoreNullFields": "false"})))

    def shown(token: Column) -> Column:
        number = rounded(token.cast("double"), 6) + F.lit(0.0)
        return F.when(token.rlike("^-?[0-9]"), F.format_string("%.6f", number)).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), shown), "")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 20)


# What of a forecast makes it the same one or another.
HOURLY_FIELDS = ("time", "temp", "rain_prob", "precip_mm", "wind_kmh", "condition")
DAILY_FIELDS = ("date", "temp_min", "temp_max", "rain_prob_max", "precip_mm", "condition")
NOWCAST_FIELDS = ("lead_min", "rain_prob")
STATUS_FIELDS = ("status", "fetched_at_utc")


def _entries(forecasts: DataFrame, column: str, fields: Sequence[str]) -> Column:
    """The named fields of an array of structs, null where it has none; entries without the first field count only if it is no key."""
    if column not in forecasts.columns:
        return F.array()
    known = forecasts.schema[column].dataType.elementType.names
    entries = F.coalesce(F.col(column), F.array().cast(forecasts.schema[column].dataType))
    if fields[0] in ("time", "date"):
        entries = F.filter(entries, lambda e: F.coalesce(e[fields[0]].cast("string"), F.lit("")) != "")
    return F.transform(entries, lambda e: F.struct(*[(e[f] if f in known else F.lit(None).cast("string")).alias(f) for f in fields]))


def snapshot_payload(forecasts: DataFrame) -> Column:
    """What of a forecast object identifies it, from the columns that the table has.

    ``hourly, daily, nowcast`` (arrays of structs), ``source_status`` (map from
    a source to a struct), ``status, sources, station, model_version``. The age
    of a cache changes with every request and is left out; when the provider's
    data were fetched is kept.
    """
    def given(name: str) -> Column:
        return F.col(name) if name in forecasts.columns else F.lit(None).cast("string")

    status: Column = F.lit(None).cast("string")
    if "source_status" in forecasts.columns:
        known = forecasts.schema["source_status"].dataType.valueType.names
        status = F.transform_values("source_status", lambda _, s: F.struct(*[(s[f] if f in known else F.lit(None).cast("string")).alias(f) for f in STATUS_FIELDS]))
    return F.struct(
        *[given(c).alias(c) for c in ("status", "sources", "station", "model_version")], status.alias("source_status"),
        _entries(forecasts, "nowcast", NOWCAST_FIELDS).alias("nowcast"), _entries(forecasts, "hourly", HOURLY_FIELDS).alias("hourly"), _entries(forecasts, "daily", DAILY_FIELDS).alias("daily"))


def with_snapshot_id(forecasts: DataFrame) -> DataFrame:
    """``snapshot_id``: equal for forecasts of equal contents, see ``snapshot_payload``."""
    return forecasts.withColumn("snapshot_id", short_hash(canonical(snapshot_payload(forecasts))))
