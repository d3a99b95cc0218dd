"""Probability verification: confusion, sweep, average precision, Brier, reliability, blend."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import finite
from ..policy import RAIN_THRESHOLD, SWEEP_STEPS
from .chunks import CHUNK, running_totals
from .lineage import cut
from .quantiles import bucket_of, cut_bounds


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of a confusion table; empty denominators give 0."""
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
        "false_alarm_rate": ratio(fp, fp + tn),
        "false_alarm_ratio": ratio(fp, tp + fp),
    }


def confusion(df: DataFrame, threshold: float, by: Sequence[str] = (), y: str = "observed", p: str = "probability") -> DataFrame:
    """Counts and rates at one threshold (alarm when p >= threshold)."""
    alarm, event = F.col(p) >= threshold, F.col(y) > 0.5
    counts = df.groupBy(*by).agg(
        F.count(F.when(alarm & event, 1)).alias("tp"), F.count(F.when(alarm & ~event, 1)).alias("fp"),
        F.count(F.when(~alarm & event, 1)).alias("fn"), F.count(F.when(~alarm & ~event, 1)).alias("tn"),
    )
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def sweep(df: DataFrame, by: Sequence[str] = (), y: str = "observed", p: str = "probability", steps: int = SWEEP_STEPS) -> DataFrame:
    """Confusion tables at 0.01, 0.02, ... from one histogram per group.

    Each row falls in the cell of the largest grid threshold it reaches; the
    99 tables are suffix sums over at most 100 cells, so data rows are never
    multiplied by the grid.
    """
    by = list(by)
    # floor(p*100) can be off by one cell from p >= k/100; correct by comparing.
    guess = F.least(F.greatest(F.floor(F.col(p) * 100.0), F.lit(0)), F.lit(steps)).cast("int")
    grid = F.when((guess < steps) & (F.col(p) >= (guess + 1) / 100.0), guess + 1).when(
        (guess > 0) & (F.col(p) < guess / 100.0), guess - 1
    ).otherwise(guess)
    cells = df.groupBy(*by, grid.alias("cell")).agg(
        F.count(F.when(F.col(y) > 0.5, 1)).alias("pos"), F.count(F.when(~(F.col(y) > 0.5), 1)).alias("neg")
    )
    arrays = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "pos", "neg")).alias("cells"))
    k = F.col("k")

    def total(field: str, keep) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, c: a + c[field])

    reached, below = (lambda c: c["cell"] >= k), (lambda c: c["cell"] < k)
    out = arrays.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *by, (k / 100.0).alias("threshold"),
        total("pos", reached).alias("tp"), total("neg", reached).alias("fp"),
        total("pos", below).alias("fn"), total("neg", below).alias("tn"),
    )
    return out.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def best_threshold(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest F1, then recall, then lowest false alarm rate, then the lower threshold."""
    order = F.struct(-F.col("f1"), -F.col("recall"), F.col("false_alarm_rate"), F.col("threshold"))
    cols = [c for c in table.columns if c not in by]
    return table.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_b")).select(*by, "_b.*")


def average_precision(df: DataFrame, by: Sequence[str], y: str = "observed", p: str = "probability") -> DataFrame:
    """Step-wise area under precision-recall; null without positives.

    Equal scores collapse first; the running counts over distinct scores are
    carried across score buckets of about equal numbers of scores, so many
    distinct scores stay parallel wherever they crowd. Scores that are null or
    not finite are left out.
    """
    by = list(by)
    scores = df.filter(finite(F.col(p).cast("double")).isNotNull()).groupBy(*by, (-F.col(p)).alias("_down")).agg(
        F.count(F.when(F.col(y) > 0.5, 1)).alias("_pos"), F.count(F.lit(1)).alias("_all"))
    keys = by or ["_every"]
    scores = cut(scores if by else scores.withColumn("_every", F.lit(0)), "scores")
    bounds = scores.groupBy(*keys).agg(cut_bounds("_down").alias("_bounds"))
    scores = scores.join(bounds, keys).withColumn(CHUNK, bucket_of(F.col("_down"), F.col("_bounds"))).drop("_bounds")
    scores = running_totals(scores, keys, ["_down"], {"_tp": F.col("_pos"), "_n": F.col("_all")})
    return scores.groupBy(*by).agg(
        F.sum("_pos").alias("positives"),
        (F.sum(F.col("_pos") * F.col("_tp") / F.col("_n")) / F.when(F.sum("_pos") > 0, F.sum("_pos"))).alias("average_precision"),
    )


def brier(df: DataFrame, by: Sequence[str] = (), y: str = "observed", p: str = "probability", extra: dict[str, str] | None = None) -> DataFrame:
    """Row count, positives and Brier score, plus the Brier of further probability columns."""
    named = {"brier": p} | (extra or {})
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("positive_rows"),
        *[F.avg((F.col(c) - F.col(y)) * (F.col(c) - F.col(y))).alias(n) for n, c in named.items()],
    )


def with_hourly_climatology(df: DataFrame, train: Column, by: Sequence[str], y: str = "observed", hour: Column | None = None) -> DataFrame:
    """Event rate of the training rows by hour (falling back to their overall rate) on every row.

    One aggregate of at most 24 rows per group, completed to all 24 hours and
    joined back by (group, hour).
    """
    by = list(by)
    df = df.withColumn("_hour", hour if hour is not None else F.hour("ts"))
    sums = df.filter(train).groupBy(*by, "_hour").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    rows = F.collect_list(F.struct("_hour", (F.col("_s") / F.col("_n")).alias("_rate")))
    packed = sums.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("_all"), F.map_from_entries(rows).alias("_m"))
    grid = packed.withColumn("_hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        *by, "_hour", F.coalesce(F.try_element_at("_m", F.col("_hour")), F.col("_all")).alias("climatology"))
    return df.join(grid, [*by, "_hour"], "left").drop("_hour")


def skill(brier_col: str, reference: str) -> Column:
    return F.when(F.col(reference) > 0, 1 - F.col(brier_col) / F.col(reference))


def reliability(df: DataFrame, by: Sequence[str] = (), y: str = "observed", p: str = "probability") -> DataFrame:
    cell = F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int").alias("bin")
    return df.groupBy(*by, cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("mean_observed")
    )


def persistence(rain: str = "rain_flag", threshold: float = RAIN_THRESHOLD) -> Column:
    return (F.col(rain) > threshold).cast("double")


def blend_weight(df: DataFrame, by: Sequence[str] = (), y: str = "observed", p: str = "probability", q: str = "persistence") -> DataFrame:
    """Least-squares weight of p against q, in [0, 1]; 1 where blending does not lower the error.

    Every error needed is a quadratic in the weight, so one aggregate of
    sums gives the weight and its check.
    """
    d, r, e = F.col(p) - F.col(q), F.col(y) - F.col(q), F.col(p) - F.col(y)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("_dd"), F.sum(r * d).alias("_rd"),
        F.sum(r * r).alias("_rr"), F.sum(e * e).alias("_ee"),
    )
    raw = F.least(F.greatest(F.col("_rd") / F.col("_dd"), F.lit(0.0)), F.lit(1.0))
    blended = (F.col("_rr") - 2 * raw * F.col("_rd") + raw * raw * F.col("_dd")) / F.col("n")
    weight = F.when(F.col("_dd") <= 2.220446049250313e-16, 1.0).when(
        blended >= F.col("_ee") / F.col("n") - 1e-12, 1.0
    ).otherwise(raw)
    return sums.select(*by, "n", weight.alias("weight"))


def blended(p: Column, q: Column, weight: Column) -> Column:
    return weight * p + (1 - weight) * q


def common_times(df: DataFrame, horizons: int, key: Sequence[str]) -> DataFrame:
    """Rows whose time occurs at every one of ``horizons`` horizons; a time given twice for one horizon is an error."""
    each = df.groupBy(*key, "horizon").agg(F.count(F.lit(1)).alias("_n"))
    once = F.when(F.max("_n") > 1, F.raise_error(F.lit("repeated prediction")).cast("long")).otherwise(F.count(F.lit(1)))
    full = each.groupBy(*key).agg(once.alias("_k")).filter(F.col("_k") == horizons)
    return df.join(full.select(*key), list(key), "left_semi")


#: Rows a model is judged on: all, those without rain now, and those also without rain over the hour before.
COHORTS = ("all", "dry_now", "dry_60m")


def in_cohorts(df: DataFrame, rain: str = "rain_flag", before: str = "rain_last_60m", threshold: float = RAIN_THRESHOLD) -> DataFrame:
    """Each row once per cohort it belongs to (``cohort``); without the column ``before`` there is no third cohort."""
    dry = F.coalesce(F.col(rain) <= threshold, F.lit(False))
    dry_60m = dry & F.coalesce(F.col(before) <= threshold, F.lit(False)) if before in df.columns else F.lit(False)
    names = F.array_compact(F.array(F.lit(COHORTS[0]), F.when(dry, COHORTS[1]), F.when(dry_60m, COHORTS[2])))
    return df.withColumn("cohort", F.explode(names))


def holdout_metrics(parts: DataFrame, threshold: float, by: Sequence[str] = (), y: str = "observed", p: str = "probability") -> DataFrame:
    """How a probability does on the rows of part ``test``, per cohort.

    Rows, positives, Brier score, average precision, counts and rates at the
    threshold, and the Brier scores of two forecasts without a model:
    persistence, and the event rate by hour in the part ``train``, with the skill
    against the latter.
    """
    by = list(by)
    known = with_hourly_climatology(parts, F.col("part") == "train", by, y)
    test = cut(in_cohorts(known.filter("part = 'test'").withColumn("persistence", persistence())), "cohorts")
    key = [*by, "cohort"]
    out = brier(test, key, y, p, extra={"climatology_brier": "climatology", "persistence_brier": "persistence"})
    out = out.withColumn("brier_skill", skill("brier", "climatology_brier"))
    area = average_precision(test, key, y, p).select(*[F.col(c).alias(f"_{c}") for c in key], "average_precision")
    counts = confusion(test, threshold, key, y, p)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return out.join(area, same, "left").drop(*[f"_{c}" for c in key]).join(counts, key).withColumn("threshold", F.lit(float(threshold)))


def once(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """``df``, or an error if a key occurs twice in it."""
    w = Window.partitionBy(*key)
    twice = F.raise_error(F.concat(F.lit(f"{what}: a row occurs more than once at "), F.concat_ws(", ", *[F.col(c).cast("string") for c in key]))).cast("boolean")
    return df.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.when(F.col("_n") > 1, twice).otherwise(True)).drop("_n")


def compare_on_common(candidate: DataFrame, reference: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Brier of two probability sets on identical rows; a row that either set repeats is an error."""
    other = once(reference, key, "reference").select(*key, F.col("probability").alias("_ref"))
    both = once(candidate, key, "candidate").join(other, list(key))
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_ref") - F.col("observed")) ** 2).alias("reference_brier"),
        F.avg((F.col("probability") - F.col("observed")) ** 2).alias("candidate_brier"),
    )
    gain = 100 * (F.col("reference_brier") - F.col("candidate_brier")) / F.col("reference_brier")
    return out.withColumn("brier_improvement_pct", F.when(F.col("reference_brier") != 0, gain))
