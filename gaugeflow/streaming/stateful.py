"""Per-station state machines: alert policy, repeat suppression, rain sessions.

Rows wait until the watermark has passed them and then step through the machine
in time order, whatever batch brought them; rows older than the watermark are
dropped by the engine. Between batches a station keeps a few numbers and the
rows that still wait. How many rows a batch brings is bounded by the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts as A
from ..operators.chunks import KEY
from ..policy import RAIN_THRESHOLD, AlertPolicy, RainStopPolicy


class Ordered(StatefulProcessor):
    """Holds the rows of a key back until the watermark passes their ``ts``; ``step`` gets them in order."""

    def __init__(self, columns: list[tuple[str, str]]):
        self.names = [c for c, _ in columns]
        self.kinds = ", ".join(f"{c} {'long' if c == 'ts' else kind}" for c, kind in columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)

    def step(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def _held(self) -> pd.DataFrame:
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=self.names)
        return held.assign(ts=pd.to_datetime(held["ts"].astype("int64"), unit="us"))

    def _release(self, key, rows: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        us = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        due = us // 1000 <= watermark
        rest = rows[~due].assign(ts=us[~due])
        if len(rest):
            self.waiting.put(list(rest[self.names].astype(object).itertuples(index=False, name=None)))
            self.handle.registerTimer(int(rest["ts"].min() // 1000 - 1))
        else:
            self.waiting.clear()
        if due.any():
            yield from self.step(key, rows[due].sort_values("ts", kind="stable"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [f[self.names] for f in rows]
        held = self._held()
        yield from self._release(key, pd.concat([held, *fresh] if len(held) else fresh), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if len(held):
            yield from self._release(key, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _run(stream: DataFrame, make, columns: list[str], out: str | T.StructType, delay: str) -> DataFrame:
    """The machine ``make`` builds from the columns it reads, fed in event-time order."""
    kinds = [(c, stream.schema[c].dataType.simpleString()) for c in columns]
    return stream.withWatermark("ts", delay).groupBy(KEY).transformWithStateInPandas(make(kinds), out, "Append", "EventTime")


class AlertMachine(Ordered):
    """Debounced rain, confirm streaks, transitions and cooldown of one station."""

    FIELDS = "dry int, model int, radar int, raining boolean, last_kind string, last_us long"

    def __init__(self, columns, policy: AlertPolicy):
        super().__init__(columns)
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("alerts", self.FIELDS)

    def _wanted(self, p: AlertPolicy, first: bool, was: tuple, now: tuple) -> list[str]:
        (rain0, model0, radar0), (rain1, model1, radar1) = was, now
        want = []
        if rain1 and not rain0:
            want.append(A.RAIN_START if first else A.RAIN_RESUME)
        elif rain0 and not rain1:
            want.append(A.RAIN_STOP)
        for on0, on1, start, stop in (
            (model0, model1, A.MODEL_ALERT, A.MODEL_CANCEL), (radar0, radar1, A.RADAR_ALERT, A.RADAR_CANCEL),
        ):
            if on1 and not on0:
                want.append(start)
            elif on0 and not on1 and not rain1:
                want.append(stop)
        return want

    def step(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        p = self.policy
        first = not self.state.exists()
        dry, model, radar, raining, kind, sent = (0, 0, 0, False, None, None) if first else self.state.get()
        out = []
        for ts, wet, alert, close in rows[["ts", "wet", "alert", "radar"]].itertuples(index=False):
            was = (raining, model >= p.confirm_streak, radar >= p.radar_streak)
            dry = 0 if wet else min(dry + 1, p.dry_polls)
            raining = bool(wet or (raining and dry < p.dry_polls))
            model = min(model + 1, p.confirm_streak) if alert and not raining else 0
            radar = min(radar + 1, p.radar_streak) if close and not raining else 0
            now = (raining, model >= p.confirm_streak, radar >= p.radar_streak)
            us = pd.Timestamp(ts).value // 1000
            accepted = []
            for want in self._wanted(p, first, was, now):
                if kind == want and us - sent < p.cooldown * 1e6:
                    continue
                kind, sent = want, us
                accepted.append(want)
            out.append((key[0], ts, *now, accepted))
            first = False
        self.state.update((dry, model, radar, raining, kind, sent))
        yield pd.DataFrame(out, columns=[KEY, "ts", "raining", "confirmed_alert", "confirmed_radar_alert", "notifications"])


def alerts(polls: DataFrame, policy: AlertPolicy = AlertPolicy(), delay: str = "10 minutes") -> DataFrame:
    """State and accepted notifications at every poll (``wet``, ``alert``, ``radar`` flags)."""
    return _run(
        polls, lambda kinds: AlertMachine(kinds, policy), ["ts", "wet", "alert", "radar"],
        f"{KEY} long, ts timestamp, raining boolean, confirmed_alert boolean, confirmed_radar_alert boolean, notifications array<string>", delay)


class LastHash(Ordered):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("last", "h string")

    def step(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        previous = frame["h"].shift(1)
        if self.state.exists():
            previous.iloc[0] = self.state.get()[0]
        self.state.update((frame["h"].iloc[-1],))
        kept = frame[frame["h"] != previous]
        if len(kept):
            yield kept


def without_repeats(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop rows whose snapshot hash ``h`` equals that of the station's row before."""
    return _run(stream, LastHash, stream.columns, stream.schema, delay)


class RainSession(Ordered):
    """Rain events closed by a run of dry samples, or censored by a gap."""

    FIELDS = "start_us long, dry int, dry_us long, last_us long"

    def __init__(self, columns, policy: RainStopPolicy, max_gap: float):
        super().__init__(columns)
        self.policy, self.max_gap = policy, int(max_gap * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("session", self.FIELDS)

    def step(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        start, dry, dry_us, last = self.state.get() if self.state.exists() else (None, 0, None, None)
        out = []
        us_all = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        wet_all = rows["rain_flag"].to_numpy() > RAIN_THRESHOLD
        # Dry rows matter only while an event is open: the first ones after a wet row, or beyond a gap.
        since_wet = np.arange(len(rows)) - np.maximum.accumulate(np.where(wet_all, np.arange(len(rows)), -1))
        for k in np.flatnonzero(wet_all | (since_wet <= self.policy.dry_rows) | ~np.maximum.accumulate(wet_all)):
            us, last = int(us_all[k]), int(us_all[k - 1]) if k else last
            if start is not None and us - last > self.max_gap:
                out.append((key[0], start, None))
                start, dry, dry_us = None, 0, None
            if wet_all[k]:
                start = us if start is None else start
                dry, dry_us = 0, None
            elif start is not None:
                dry, dry_us = dry + 1, us if dry_us is None else dry_us
                if dry >= self.policy.dry_rows:
                    out.append((key[0], start, dry_us))
                    start, dry, dry_us = None, 0, None
        self.state.update((start, dry, dry_us, int(us_all[-1])))
        if out:
            frame = pd.DataFrame(out, columns=[KEY, "start_us", "stop_us"])
            yield frame.astype({KEY: "int64", "start_us": "int64", "stop_us": "Int64"})


def rain_sessions(readings: DataFrame, policy: RainStopPolicy = RainStopPolicy(), max_gap: float = 150.0, delay: str = "10 minutes") -> DataFrame:
    """Closed rain events as they end (``stop_us`` null when a gap censored the event)."""
    return _run(readings, lambda kinds: RainSession(kinds, policy, max_gap), ["ts", "rain_flag"], f"{KEY} long, start_us long, stop_us long", delay)
