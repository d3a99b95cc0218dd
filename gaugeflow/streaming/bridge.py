"""Live bridging: rows that stand in for a station that has fallen silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunks import KEY, micros
from ..operators.segments import FILLED, TAIL
from ..policy import LiveRule

#: Names the clock column: the time at which a row was emitted.
EMITTED = "emitted_at"


class Bridge(StatefulProcessor):
    """Passes rows on and repeats the newest one of a station that has been silent for a while.

    Between micro-batches a station keeps its newest row and the time of the
    last row made from it. A timer of processing time wakes it when its next row
    is due, and no more once the silence is too long.
    """

    def __init__(self, columns: list[str], kinds: str, rule: LiveRule, clock: Callable[[int], int]):
        self.columns, self.kinds, self.rule, self.clock = columns, kinds, rule, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.kinds)
        self.made = handle.getValueState("made", "last_us long")

    def _bridged(self, key, wall_ms: int) -> Iterator[pd.DataFrame]:
        """Rows that are due now, and the timer of the next one."""
        row = dict(zip(self.columns, self.newest.get()))
        now, seen, last = self.clock(wall_ms) * 1000, row["ts"], self.made.get()[0]
        step, fresh, bridged, slack = (micros(v) for v in (self.rule.step, self.rule.fresh, self.rule.bridged, self.rule.slack))
        if now - seen > bridged:
            return  # too long: nothing stands in for it until it reports again
        if now - seen > fresh:
            due = list(range(last + step, now - slack + 1, step))
            if due:
                self.made.update((due[-1],))
                last = due[-1]
                rows = pd.DataFrame([row] * len(due)).assign(**{KEY: key[0], FILLED: 1.0, TAIL: 1.0, EMITTED: pd.to_datetime(now, unit="us")})
                yield rows.assign(ts=pd.to_datetime(pd.Series(due), unit="us"))
        # Due when the silence is long enough and the next row is at least ``slack`` old.
        wait = max(seen + fresh + 1000, last + step + slack) - now
        self.handle.registerTimer(wall_ms + max(1, -(-wait // 1000)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        wall = timerValues.getCurrentProcessingTimeInMs()
        best = None
        for frame in rows:
            us = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            top = int(us.argmax())
            if best is None or us[top] > best[0]:
                best = int(us[top]), frame.iloc[top]
            yield frame[[KEY, *self.columns]].assign(**{FILLED: 0.0, TAIL: 0.0, EMITTED: pd.to_datetime(self.clock(wall) * 1000, unit="us")})
        known = self.newest.get()[self.columns.index("ts")] if self.newest.exists() else None
        if known is None or best[0] > known:
            row = [best[0] if c == "ts" else None if pd.isna(best[1][c]) else best[1][c] for c in self.columns]
            self.newest.update(tuple(v.item() if hasattr(v, "item") else v for v in row))
            self.made.update((best[0],))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield from self._bridged(key, wall)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._bridged(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def same_clock(wall_ms: int) -> int:
    return wall_ms


def bridge(stream: DataFrame, rule: LiveRule = LiveRule(), clock: Callable[[int], int] = same_clock) -> DataFrame:
    """The rows of ``stream`` and, for a silent station, stand-ins of its newest row.

    As long as a station's newest row is older than ``rule.fresh`` seconds and
    not older than ``rule.bridged``, a copy comes out for every ``rule.step``
    after it that is at least ``rule.slack`` seconds past, marked as filled and
    simulated; then nothing more until the station reports again. Copies follow
    the clock, not the data, so they come while the stream is idle. What has
    come out at a time is what ``extend_tail`` makes at that time. ``clock``
    turns the engine's time (milliseconds) into that of the data, for replays.
    Rows need a station and a time; columns are numbers, texts or booleans.
    """
    columns = [c for c in stream.columns if c not in (KEY, FILLED, TAIL, EMITTED)]
    kinds = ", ".join(f"{c} {'long' if c == 'ts' else stream.schema[c].dataType.simpleString()}" for c in columns)
    rows = stream.select(KEY, *columns)
    out = T.StructType([*rows.schema.fields, T.StructField(FILLED, T.DoubleType()), T.StructField(TAIL, T.DoubleType()), T.StructField(EMITTED, T.TimestampType())])
    return rows.groupBy(KEY).transformWithStateInPandas(Bridge(columns, kinds, rule, clock), out, "Append", "ProcessingTime")
