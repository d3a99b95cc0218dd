"""Distribution drift: quantile-binned baseline per feature and PSI against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import DriftPolicy
from .lineage import cut
from .quantiles import quantiles_of_counts


def long_features(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows without nulls, after the columns ``by``; features absent from the frame give none."""
    present = [f for f in features if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in present])
    return df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct values per feature with their multiplicity, stored because several steps read them."""
    return cut(value_state(df, features), "values")


def value_state(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How often each value of each feature occurs: all that the baseline and the comparison need, and counts can be added up."""
    return long_features(df, features, by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("_c"))


def merged_values(states: DataFrame) -> DataFrame:
    """Value states of several days added up, stored because several steps read them."""
    return cut(states.groupBy("feature", "value").agg(F.sum("_c").alias("_c")), "values")


def bin_of(value: Column, edges: Column) -> Column:
    """0-based histogram bin; the last bin is closed, values outside go to the edge bins."""
    inner = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(value >= e, 1).otherwise(0))
    return F.least(F.greatest(inner - 1, F.lit(0)), F.size(edges) - 2)


def _histogram(counted: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per bin as an array ordered by bin, zeros included.

    ``edges`` has one row per feature (a few hundred), so the join broadcasts.
    """
    hits = counted.join(edges, "feature").withColumn("bin", bin_of(F.col("value"), F.col("edges")))
    per_bin = hits.groupBy("feature", "bin").agg(F.sum("_c").alias("c"))
    maps = per_bin.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    bins = F.sequence(F.lit(0), F.size("edges") - 2)
    return maps.join(edges, "feature").select(
        "feature", "edges",
        F.transform(bins, lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double")).alias("counts"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def baseline(df: DataFrame, features: Sequence[str], policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """Per feature: n, mean, population std, unique quantile edges, smoothed bin proportions."""
    return baseline_of_values(value_counts(df, features), policy)


def baseline_of_values(counted: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """The baseline of counted values (see ``value_counts`` and ``merged_values``)."""
    qs = [k / policy.bins for k in range(policy.bins + 1)]
    mean = F.sum(F.col("value") * F.col("_c")) / F.sum("_c")
    quantiles = quantiles_of_counts(counted, ["feature"], "value", qs, extra=[mean.alias("mean")], stored=True)
    quantiles = cut(quantiles, "quantiles")
    off = F.col("value") - F.col("mean")
    spread = counted.join(quantiles.select("feature", "mean"), "feature").groupBy("feature").agg(
        F.sqrt(F.sum(off * off * F.col("_c")) / F.sum("_c")).alias("std"))
    unique = F.array_distinct("q")
    edges = F.when(F.size(unique) >= 2, unique).otherwise(
        F.array(F.element_at("q", 1) - 0.5, F.element_at("q", -1) + 0.5))
    facts = quantiles.select("feature", "n", "mean", edges.alias("edges")).join(spread, "feature")
    hist = _histogram(counted, facts.select("feature", "edges")).drop("edges")
    smooth = F.lit(policy.floor)
    share = F.transform("counts", lambda c: (c + smooth) / (total(F.col("counts")) + smooth * F.size("counts")))
    return facts.join(hist, "feature").select("feature", "n", "mean", "std", "edges", share.alias("proportions"))


def compare(df: DataFrame, base: DataFrame, features: Sequence[str], policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """PSI and standardised mean shift per baseline feature, with its status.

    A baseline feature without recent values is reported as ``missing``.
    """
    return compare_values(value_counts(df, features), base, policy)


def compare_values(counted: DataFrame, base: DataFrame, policy: DriftPolicy = DriftPolicy()) -> DataFrame:
    """The comparison of counted values (see ``value_counts`` and ``merged_values``) with a baseline."""
    hist = _histogram(counted, base.select("feature", "edges")).drop("edges")
    moments = counted.groupBy("feature").agg(
        F.sum("_c").alias("n_recent"), (F.sum(F.col("value") * F.col("_c")) / F.sum("_c")).alias("mean_recent"))
    low = F.lit(policy.floor)
    expected = F.transform("proportions", lambda e: F.greatest(e / total(F.col("proportions")), low))
    actual = F.transform("counts", lambda c: F.greatest(c / total(F.col("counts")), low))
    terms = F.zip_with(expected, actual, lambda e, a: (a - e) * F.log(a / e))
    psi = F.when(F.col("counts").isNotNull(), total(terms))
    shift = (F.col("mean_recent") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-6))
    out = base.join(hist, "feature", "left").join(moments, "feature", "left").select(
        "feature", F.coalesce("n_recent", F.lit(0)).alias("n"), psi.alias("psi"), shift.alias("mean_shift"))
    status = (
        F.when(F.col("n") == 0, "missing").when(F.col("psi") >= policy.high, "high")
        .when(F.col("psi") >= policy.watch, "watch").otherwise("ok")
    )
    return out.withColumn("status", status)


def summary(drift: DataFrame) -> DataFrame:
    """Mean PSI, feature count and the sorted list of highly drifted features."""
    return drift.agg(
        F.avg("psi").alias("mean_psi"), F.count(F.lit(1)).alias("n_features"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "high", F.col("feature")))).alias("high_drift_features"))
