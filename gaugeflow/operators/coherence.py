"""Nested-horizon probabilities made non-decreasing by equal-weight isotonic projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(values: Sequence[Column]) -> list[Column]:
    """Isotonic projection of a short ordered list, in closed form.

    The i-th value is max over starts j<=i of min over ends k>=i of the mean of
    j..k; with at most five horizons that is a handful of column expressions.
    Already ordered input passes through untouched.
    """
    n = len(values)

    def mean(j: int, k: int) -> Column:
        total = values[j]
        for v in values[j + 1: k + 1]:
            total = total + v
        return total / float(k - j + 1)

    def extreme(fn, cols: list[Column]) -> Column:
        return cols[0] if len(cols) == 1 else fn(*cols)

    ordered = F.lit(True)
    for a, b in zip(values, values[1:]):
        ordered = ordered & (a <= b)
    out = []
    for i in range(n):
        starts = [extreme(F.least, [mean(j, k) for k in range(i, n)]) for j in range(i + 1)]
        out.append(F.when(ordered, values[i]).otherwise(extreme(F.greatest, starts)))
    return out


def checked(value: Column, name: str) -> Column:
    """Fail the job on a probability outside [0, 1] or not finite."""
    bad = value.isNull() | F.isnan(value) | (value < 0.0) | (value > 1.0)
    return F.when(bad, F.raise_error(F.lit(f"probability {name} must be finite and in [0, 1]")).cast("double")).otherwise(value)


def coherent(df: DataFrame, horizons: Sequence[int], prefix: str = "p_", suffix: str = "m", validate: bool = True) -> DataFrame:
    """Replace p_<h>m columns by their projection, keeping ``unadjusted_<...>`` copies."""
    names = [f"{prefix}{h}{suffix}" for h in sorted(horizons)]
    raw = {f"unadjusted_{n}": (checked(F.col(n), n) if validate else F.col(n)) for n in names}
    df = df.withColumns(raw)
    return df.withColumns(dict(zip(names, project([F.col(f"unadjusted_{n}") for n in names]))))


def check_nested(df: DataFrame, horizons: Sequence[int], prefix: str = "observed_", suffix: str = "m") -> DataFrame:
    """Fail if a shorter window saw an event that a longer one did not."""
    names = [f"{prefix}{h}{suffix}" for h in sorted(horizons)]
    broken = F.lit(False)
    for a, b in zip(names, names[1:]):
        broken = broken | (F.col(a) > F.col(b))
    guard = F.when(broken, F.raise_error(F.lit("window labels must be nested across horizons")).cast("int")).otherwise(1)
    return df.withColumn("_guard", guard).filter("_guard = 1").drop("_guard")
