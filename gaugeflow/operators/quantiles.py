"""Exact quantiles with linear interpolation that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import finite
from .chunks import CHUNK, running_total
from .lineage import cut


FAN = 16  # bounds are searched in two steps of so many


def cut_bounds(value: str | Column) -> Column:
    """Aggregate: bounds that cut a group's values into ``FAN`` squared buckets of about equal size."""
    steps = FAN * FAN
    return F.percentile_approx(value, [k / steps for k in range(1, steps)], 20 * steps)


def bucket_of(value: Column, bounds: Column) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``."""
    def low(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b <= value))

    coarse = F.transform(F.sequence(F.lit(FAN), F.lit(FAN * FAN - FAN), F.lit(FAN)), lambda k: F.element_at(bounds, k))
    found = F.transform(F.array(low(coarse)), lambda i: i * FAN + low(F.slice(bounds, i * FAN + 1, F.lit(FAN - 1))))
    return F.element_at(found, 1).cast("long")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], out: str = "q", min_n: int = 1, extra: Sequence[Column] = (),
) -> DataFrame:
    """Per group: ``n``, further aggregates and an array ``out`` of the quantiles ``qs``; values that are not finite are left out."""
    counts = df.filter(finite(F.col(value).cast("double")).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return quantiles_of_counts(counts, by, value, qs, out, min_n, extra)


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], out: str = "q", min_n: int = 1,
    extra: Sequence[Column] = (), stored: bool = False,
) -> DataFrame:
    """Quantiles of distinct values with multiplicity ``_c``.

    The built-in exact percentile keeps every distinct value of a group in one
    task.  Here each group's values are cut into buckets at approximate
    quantiles, so that neither an outlier nor a crowd fills one bucket; counts
    are carried across the buckets, and only the values sitting on a wanted rank reach the
    final aggregate.  ``extra`` aggregates may use ``value`` and ``_c``.  The
    counts feed three steps, so they are stored once unless they already are.
    """
    by = list(by)
    keys = by or ["_all"]
    if not by:
        counts = counts.withColumn("_all", F.lit(0))
    counts = counts.filter(finite(F.col(value).cast("double")).isNotNull())
    if not stored:
        counts = cut(counts, "counts")
    span = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), cut_bounds(value).alias("_bounds"), *extra
    ).filter(F.col("n") >= min_n)
    names = [c for c in span.columns if c not in (*keys, "_bounds")]
    # One row per group: AQE broadcasts it only if its measured size allows.
    counts = counts.join(span, keys)
    counts = counts.withColumn(CHUNK, bucket_of(F.col(value), F.col("_bounds"))).drop("_bounds")
    ranked = running_total(counts, keys, [value], F.col("_c"), "_upto")
    low = F.col("_upto") - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((low <= rank) & (rank < F.col("_upto")), F.col(value)))

    picks = []
    for i, q in enumerate(qs):
        rank = (F.col("n") - 1) * F.lit(float(q))
        picks += [at(F.floor(rank)).alias(f"_l{i}"), at(F.ceil(rank)).alias(f"_u{i}"),
                  F.max(rank - F.floor(rank)).alias(f"_f{i}")]
    res = ranked.groupBy(*keys, *names).agg(*picks)
    points = [F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(qs))]
    return res.select(*by, *names, F.array(*points).alias(out))
