"""The windowed features of a chunk as arrays, for callers that want most of them.

:mod:`.features` spells a feature as window expressions, which is cheapest for
a family of columns; for all of them Spark passes every row through hundreds of
frames and projections too long to be compiled. Here Spark deals out the chunks
by the same shuffle, and a task takes a chunk (a day of a station and its halo)
through the same sums as whole columns. Every step rounds as its expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import features as X
from .chunks import CHUNK, CORE, KEY, US
from .segments import SEG

#: Values of the rows, and which of them are not null.
Cells = tuple[np.ndarray, np.ndarray]


class ChunkRows:
    """Rows of one chunk in the order of its segments and times."""

    def __init__(self, table: pa.Table):
        seg, us = (table[c].to_numpy() for c in (SEG, US))
        self.table = table.take(pa.array(np.lexsort((us, seg))))
        seg = np.sort(seg)
        at = np.arange(len(seg))
        self.nth = at - np.maximum.accumulate(np.where(np.diff(seg, prepend=seg[:1] - 1) != 0, at, 0))
        self.known: dict = {}

    def cells(self, name: str) -> Cells:
        if name not in self.known:
            column = pc.cast(self.table[name].combine_chunks(), pa.float64())
            self.known[name] = pc.fill_null(column, 0.0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        return self.known[name]

    def lag(self, cells: Cells, n: int) -> Cells:
        """The cells ``n`` rows before in the same segment."""
        out = tuple(np.zeros_like(v) for v in cells)
        if n < len(self.nth):
            for v, shifted in zip(cells, out):
                shifted[n:] = v[:len(v) - n]
        return out[0], out[1] & (self.nth >= n)

    def change(self, cells: Cells, n: int) -> Cells:
        then = self.lag(cells, n)
        return cells[0] - then[0], cells[1] & then[1]

    def slope(self, name: str, n: int) -> Cells:
        us = self.table[US].to_numpy()
        elapsed, there = self.change((us, np.ones(len(us), bool)), n)
        minutes, (value, both) = elapsed / 60e6, self.change(self.cells(name), n)
        later = there & (minutes > 0)
        return value / np.where(later, minutes, 1.0), both & later

    def part(self, stat: str, c: str, n: int) -> Cells:
        """Statistic of ``n`` rows; of more than a base window from those of its pieces, null unless all exist."""
        key = (stat, c, n)
        if key not in self.known:
            self.known[key] = self._base(stat, c) if n == X.BASE else self._joined(stat, c, n)
        return self.known[key]

    def _base(self, stat: str, c: str) -> Cells:
        rows = [self.lag(self.cells(c), i) for i in reversed(range(X.BASE))]
        full = np.logical_and.reduce([ok for _, ok in rows])
        if stat in ("min", "max"):  # a NaN is the greatest value
            return (np.fmin if stat == "min" else np.maximum).reduce([v for v, _ in rows]), full
        total, mean, m2 = 0.0, 0.0, 0.0
        for i, (v, _) in enumerate(rows):
            delta = v - mean
            step = delta / (i + 1.0)
            total, mean, m2 = total + v, mean + step, m2 + delta * (delta - step)
        return (total / X.BASE if stat == "mean" else m2 / X.BASE * float(X.BASE)), full

    def _joined(self, stat: str, c: str, n: int) -> Cells:
        pieces = next(level[n] for level in X.LADDER if n in level)
        before = [sum(pieces[:i]) for i in range(len(pieces))]

        def all_of(s: str) -> list[Cells]:
            return [self.lag(self.part(s, c, k), at) for k, at in zip(pieces, before)]

        values = all_of(stat)
        full = np.logical_and.reduce([ok for _, ok in values])
        if stat in ("min", "max"):
            return (np.fmin if stat == "min" else np.maximum).reduce([v for v, _ in values]), full
        means = [v for v, _ in (values if stat == "mean" else all_of("mean"))]
        mean = sum((m * float(k) for m, k in zip(means, pieces)), 0.0) / float(n)
        if stat == "mean":
            return mean, full
        return sum((v + float(k) * (m - mean) * (m - mean) for (v, _), m, k in zip(values, means, pieces)), 0.0), full

    def bright(self, cells: Cells) -> Cells:
        day, ok = self.cells("daylight_available")
        return np.where(ok & (day > 0.0) & cells[1], cells[0], 0.0), np.ones(len(day), bool)

    def feature(self, name: str) -> Cells:
        if name in _LAGS:
            c, n = _LAGS[name]
            return self.lag(self.cells(c), n) if name.endswith("_ago") else self.change(self.cells(c), n)
        if name in _ROLLS:
            stat, c, n = _ROLLS[name]
            value, full = self.part(stat, c, n)
            return (np.sqrt(value / float(n - 1)) if stat == "m2" else value), full
        kind, c, n = _CHANGES[name]
        if kind == "slope":
            return self.slope(c, n)
        value, both = self.change(self.feature(c) if c in _LAGS or c in _ROLLS else self.cells(c), n)
        if kind in ("rate", "bright rate"):
            value = value / float(n)
        return self.bright((value, both)) if kind.startswith("bright") else (value, both)


_LAGS, _ROLLS = X.lag_spec(), X.rolling_names()
#: Feature -> (how, column, rows) of the changes of :mod:`.features`.
_CHANGES = (
    {f"{c}_slope_{n}m": ("slope", c, n) for cols, windows in ((X.CORE3, (5, 10, 30)), (("wind_speed", "wind_gust"), (10, 30, 60))) for c in cols for n in windows}
    | {f"{c}_roc_{n}m": ("rate", c, n) for c in X.CORE3 for n in (15, 30, 60)}
    | {f"light_drop_vs_expected_{n}m": ("bright", "clear_sky_light_ratio", n) for n in (5, 10, 30)}
    | {f"light_slope_{n}m": ("bright rate", "light", n) for n in (5, 10, 30)}
    | {f"rain_slope_{n}m": ("change", f"rain_frac_{n}m", n) for n in (5, 10, 30)}
    | {"pressure_accel_30m": ("change", "pressure_delta_30m", 30), "dewpoint_gap_delta_30m": ("change", "temp_dewpoint_gap", 30),
       "dew_point_delta_30m": ("change", "dew_point", 30)})


def add_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """As :func:`.features.add_features`, on the core rows alone; windowed features are doubles."""
    wanted = set(names)
    windowed = [n for n in names if n in _LAGS or n in _ROLLS or n in _CHANGES]
    df = X.add_pointwise(df, wanted)
    kept = df.drop(CORE).columns

    def of_chunk(table: pa.Table) -> pa.Table:
        rows = ChunkRows(table)
        core = np.flatnonzero(rows.table[CORE].to_numpy())
        with np.errstate(all="ignore"):
            made = [rows.feature(n) for n in windowed]
        columns = [pa.array(v[core], pa.float64(), mask=~ok[core], from_pandas=False) for v, ok in made]
        return pa.table([*rows.table.select(kept).take(pa.array(core)).columns, *columns], [*kept, *windowed])

    fields = [df.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in windowed]
    return df.groupBy(KEY, CHUNK).applyInArrow(of_chunk, T.StructType(fields))
