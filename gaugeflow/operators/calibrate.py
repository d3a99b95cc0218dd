"""Forecast bias (median error) and residual-quantile intervals: fit, look up, apply, hold out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..policy import BiasPolicy, IntervalPolicy
from .asof import nearest_within
from .chunks import KEY, cut_points
from .lineage import cut
from .quantiles import quantiles_of_counts
from .scoring import hour_of

GLOBAL, LEAD, HOUR_SCOPE = "global", "lead", "hour"


def error_state(pairs: DataFrame, error: str = "error_c", by: Sequence[str] = ()) -> DataFrame:
    """How often each error occurs per lead and issue hour: all that the fits need, and counts can be added up."""
    known = pairs.filter(F.col(error).isNotNull() & F.col("lead_hours").isNotNull())
    return known.groupBy(*by, "lead_hours", "issue_hour", F.col(error).alias("error")).agg(F.count(F.lit(1)).alias("_k"))


def _scoped(small: DataFrame, scopes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per (scope, key, distinct error), equal errors collapsed before the scopes multiply them."""
    kinds = {
        GLOBAL: F.lit(None).cast("int"), LEAD: F.col("lead_hours").cast("int"),
        HOUR_SCOPE: F.pmod(F.col("issue_hour"), F.lit(24)).cast("int"),
    }
    sets = F.array(*[F.struct(F.lit(s).alias("scope"), kinds[s].alias("key")) for s in scopes])
    rows = small.withColumn("_s", F.explode(sets)).select(*by, "_s.scope", "_s.key", "error", "_k")
    return rows.filter((F.col("scope") == GLOBAL) | F.col("key").isNotNull())


def _fit(small: DataFrame, scopes, by, qs, min_samples: int) -> DataFrame:
    rows = _scoped(small, scopes, by).groupBy(*by, "scope", "key", "error").agg(F.sum("_k").alias("_k"))
    # Integer multiplicities expand the rank arithmetic, not the rows.
    return weighted_quantiles(rows, [*by, "scope", "key"], "error", "_k", qs, min_samples)


def weighted_quantiles(df: DataFrame, by, value: str, weight: str, qs, min_n: int) -> DataFrame:
    """Exact quantiles of values repeated ``weight`` times; ``key`` may be null, so -1 stands in."""
    counts = df.withColumn("key", F.coalesce("key", F.lit(-1))).withColumnRenamed(weight, "_c")
    mean = F.sum(F.col(value) * F.col("_c")) / F.sum("_c")
    fit = quantiles_of_counts(counts, by, value, qs, "q", min_n, extra=[mean.alias("mean")])
    return fit.withColumn("key", F.when(F.col("scope") != GLOBAL, F.col("key")))


def fit_bias(pairs: DataFrame, error: str = "error_c", by: Sequence[str] = (), policy: BiasPolicy = BiasPolicy()) -> DataFrame:
    """Median and mean observed-minus-forecast error: global, per lead, per issue hour.

    Rows ``(scope, key, n, median_c, mean_c)``; scopes with fewer than
    ``min_samples`` pairs are left out, and so is the whole model of a group
    whose global scope is too small.
    """
    return bias_of_states(error_state(pairs, error, by), by, policy)


def bias_of_states(states: DataFrame, by: Sequence[str] = (), policy: BiasPolicy = BiasPolicy()) -> DataFrame:
    """The model that ``fit_bias`` makes of the pairs behind the states (see ``error_state``)."""
    fit = _fit(states, (GLOBAL, LEAD, HOUR_SCOPE), by, (0.5,), policy.min_samples)
    return fit.select(
        *by, "scope", "key", "n", rounded(F.element_at("q", 1), 6).alias("median_c"), rounded(F.col("mean"), 6).alias("mean_c"))


def fit_interval(pairs: DataFrame, error: str = "error_c", by: Sequence[str] = (), policy: IntervalPolicy = IntervalPolicy()) -> DataFrame:
    """Residual quantiles bounding ``coverage`` of the errors: global and per lead."""
    return interval_of_states(error_state(pairs, error, by), by, policy)


def interval_of_states(states: DataFrame, by: Sequence[str] = (), policy: IntervalPolicy = IntervalPolicy()) -> DataFrame:
    """The model that ``fit_interval`` makes of the pairs behind the states (see ``error_state``)."""
    tail = (1.0 - policy.coverage) * 50.0 / 100.0
    fit = _fit(states, (GLOBAL, LEAD), by, (tail, 1.0 - tail, 0.5), policy.min_samples)
    q = [rounded(F.element_at("q", i), 4) for i in (1, 2, 3)]
    return fit.select(
        *by, "scope", "key", "n",
        q[0].alias("lower_error_c"), q[1].alias("upper_error_c"), q[2].alias("median_error_c"))


def _scope(model: DataFrame, scope: str, key: str | None, by, cols: dict[str, str]) -> DataFrame:
    picked = model.filter(F.col("scope") == scope)
    return picked.select(*by, *([F.col("key").alias(key)] if key else []), *[F.col(a).alias(b) for a, b in cols.items()])


def _with_global(df: DataFrame, model: DataFrame, by, cols: dict[str, str]) -> DataFrame:
    """Attach the global scope: by key, or as scalar subqueries when there is one model for all."""
    if by:
        return df.join(_scope(model, GLOBAL, None, by, cols), list(by), "left")
    row = model.filter(F.col("scope") == GLOBAL)
    return df.withColumns({b: row.select(a).scalar() for a, b in cols.items()})


def look_up_bias(df: DataFrame, model: DataFrame, hour: Column, by: Sequence[str] = (), policy: BiasPolicy = BiasPolicy()) -> DataFrame:
    """Add ``correction``: the lead's median, else the hour's, else the global one, clamped."""
    by = list(by)
    df = df.withColumn("_lead", F.col("lead_hours").cast("int")).withColumn("_hour", F.pmod(hour, F.lit(24)).cast("int"))
    df = df.join(_scope(model, LEAD, "_lead", by, {"median_c": "_m1"}), [*by, "_lead"], "left")
    df = df.join(_scope(model, HOUR_SCOPE, "_hour", by, {"median_c": "_m2"}), [*by, "_hour"], "left")
    df = _with_global(df, model, by, {"median_c": "_m3"})
    found = F.coalesce("_m1", "_m2", "_m3", F.lit(0.0))
    clamped = F.least(F.greatest(found, F.lit(-policy.clamp)), F.lit(policy.clamp))
    return df.withColumn("correction", clamped).drop("_lead", "_hour", "_m1", "_m2", "_m3")


def apply_bias(timeline: DataFrame, model: DataFrame, valid_hour: Column, by: Sequence[str] = ()) -> DataFrame:
    """Corrected temperatures next to the raw ones; a missing temperature passes through."""
    df = look_up_bias(timeline, model, valid_hour, by)
    known = F.col("temp").isNotNull()
    return df.withColumns({
        "temp_raw": F.col("temp"),
        "temp_bias_correction": F.when(known, F.col("correction")).otherwise(0.0),
        "temp": F.when(known, rounded(F.col("temp") + F.col("correction"), 3)),
    }).drop("correction")


def look_up_interval(df: DataFrame, model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add bounds of the lead, else the global ones; crossed bounds count as none."""
    by = list(by)
    cols = ("lower_error_c", "upper_error_c", "n")
    df = df.withColumn("_lead", F.col("lead_hours").cast("int"))
    df = df.join(_scope(model, LEAD, "_lead", by, {c: f"_a_{c}" for c in cols}), [*by, "_lead"], "left")
    df = _with_global(df, model, by, {c: f"_b_{c}" for c in cols})
    has_lead = F.col("_a_n").isNotNull()
    pick = {c: F.when(has_lead, F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")) for c in cols}
    valid = pick["lower_error_c"] <= pick["upper_error_c"]
    return df.withColumns({
        "lower_error_c": F.when(valid, pick["lower_error_c"]), "upper_error_c": F.when(valid, pick["upper_error_c"]),
        "samples": F.when(valid, pick["n"]),
    }).drop("_lead", *[f"_{s}_{c}" for s in "ab" for c in cols])


def apply_interval(
    timeline: DataFrame, model: DataFrame, by: Sequence[str] = (), center: str = "none", corrected: Column | None = None
) -> DataFrame:
    """Temperature bounds; a model of corrected forecasts is never put on a raw forecast."""
    df = look_up_interval(timeline, model, by)
    usable = F.col("temp").isNotNull() & F.col("lower_error_c").isNotNull()
    if center == "nwp_bias_correction":
        usable = usable & F.coalesce(corrected if corrected is not None else F.lit(False), F.lit(False))
    return df.withColumns({
        "interval_lower": F.when(usable, rounded(F.col("temp") + F.col("lower_error_c"), 2)),
        "interval_upper": F.when(usable, rounded(F.col("temp") + F.col("upper_error_c"), 2)),
        "interval_samples": F.when(usable, F.col("samples")),
    }).drop("lower_error_c", "upper_error_c", "samples")


def error_pairs(
    log: DataFrame, observations: DataFrame, policy: IntervalPolicy = IntervalPolicy(), bias: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Forecasts paired with the nearest observation: ``error_c`` = observed - (corrected) forecast."""
    joined = nearest_within(
        log.filter(F.col("temp_forecast").isNotNull()), "valid_at", observations, "ts", "temp", policy.tolerance_minutes * 60)
    joined = joined.filter(F.col("temp").isNotNull()).withColumn("issue_hour", hour_of(F.unix_micros("issued_hour")))
    center = F.col("temp_forecast")
    if bias is not None:
        joined = look_up_bias(joined, bias, F.col("issue_hour"), by)
        center = center + F.col("correction")
    joined = joined.withColumn("center_temp", center)
    return joined.select(
        KEY, "issued_hour", "valid_at", "lead_hours", "issue_hour", (F.col("temp") - F.col("center_temp")).alias("error_c"))


def holdout_split(pairs: DataFrame, by: Sequence[str], order: Sequence[str], policy: IntervalPolicy = IntervalPolicy()) -> DataFrame:
    """Flag the last fraction of each group in time order as ``holdout``."""
    by = list(by)
    first = {"_start": lambda n: F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(1.0 - policy.holdout))))}
    starts = cut(cut_points(pairs, by, order, first), "starts")
    late = F.coalesce(F.struct(*order) >= F.col("_start"), F.lit(False))
    return pairs.join(starts, by).withColumn("holdout", late).drop("_start", "_total")


def evaluate_interval(split: DataFrame, by: Sequence[str], policy: IntervalPolicy = IntervalPolicy()) -> tuple[DataFrame, DataFrame]:
    """Interval model of the earlier part and its coverage and width on the holdout."""
    by = list(by)
    model = fit_interval(split.filter(~F.col("holdout")), by=by, policy=policy)
    held = look_up_interval(split.filter("holdout"), model, by)
    inside = (F.col("error_c") >= F.col("lower_error_c")) & (F.col("error_c") <= F.col("upper_error_c"))
    report = held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("paired_rows"), F.count("lower_error_c").alias("interval_rows"),
        F.avg(inside.cast("int")).alias("coverage"),
        F.avg(F.col("upper_error_c") - F.col("lower_error_c")).alias("mean_width_c"),
    )
    return model, report
