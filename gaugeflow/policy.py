"""Tunable constants, grouped by the operator family that reads them.

Every operator takes one of these frozen records (or its fields) as an
argument, so nothing below is hidden global state.
"""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000  # microseconds; all time arithmetic is on epoch micros
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

RAIN_THRESHOLD = 0.10  # wet means strictly greater
HORIZONS = (5, 10, 30, 60, 120)  # minutes
LOCAL_OFFSET_HOURS = 7  # local wall clock = UTC + 7 h


@dataclass(frozen=True)
class Cadence:
    """Sampling rule of the feature series (seconds)."""

    nominal: float = 60.0
    burst_max: float = 5.0
    min_valid: float = 20.0
    fill_over: float = 90.0  # fill when fill_over < gap <= fill_upto
    fill_upto: float = 630.0


@dataclass(frozen=True)
class GapRule:
    """A segment breaks where the gap is < low or > high seconds."""

    low: float
    high: float


FEATURE_GAPS = GapRule(20.0, 630.0)
AUDIT_GAPS = GapRule(20.0, 90.0)
RAIN_STOP_GAPS = GapRule(-1.0, 150.0)


@dataclass(frozen=True)
class LabelRule:
    jitter: float = 30.0  # seconds of cadence drift allowed over a window
    dry_rows: int = 60  # dry antecedent of an onset


@dataclass(frozen=True)
class SplitRule:
    fractions: tuple = (0.6, 0.7, 0.8)
    names: tuple = ("train", "calibration", "validation", "test")
    jitter: float = 30.0
    min_rows: int = 100


@dataclass(frozen=True)
class LiveRule:
    fresh: float = 180.0
    bridged: float = 600.0
    step: float = 60.0
    slack: float = 20.0
    future: float = 60.0
    context_rows: int = 120


@dataclass(frozen=True)
class MatchRule:
    point_tolerance: float = 90.0
    window_tolerance: float = 30.0
    lookback_days: int = 1
    max_lead: int = 120


@dataclass(frozen=True)
class AlertPolicy:
    confirm_streak: int = 3
    min_horizons: int = 2
    dry_polls: int = 3
    radar_streak: int = 5
    radar_class: int = 2
    cooldown: float = 1800.0


@dataclass(frozen=True)
class RevisionPolicy:
    rain_window: float = 50.0
    probability_points: float = 20.0
    temperature: float = 2.0
    shift_minutes: float = 60.0
    cooldown: float = 3600.0


@dataclass(frozen=True)
class DriftPolicy:
    bins: int = 10
    floor: float = 1e-6
    watch: float = 0.10
    high: float = 0.25


@dataclass(frozen=True)
class BiasPolicy:
    min_samples: int = 50
    clamp: float = 6.0


@dataclass(frozen=True)
class IntervalPolicy:
    coverage: float = 0.80
    min_samples: int = 30
    holdout: float = 0.20
    tolerance_minutes: float = 8.0


@dataclass(frozen=True)
class RainStopPolicy:
    dry_rows: int = 10
    min_events: int = 3
    stale: float = 150.0


@dataclass(frozen=True)
class GridPolicy:
    """Radar grid geometry and motion search."""

    zoom: int = 7
    tile: int = 256
    tiles_per_side: int = 3
    window: int = 300
    max_shift: int = 30
    shift_step: int = 2
    lookahead: int = 120
    lookahead_step: int = 5
    frames: int = 4
    ring_frames: int = 6
    wet_class: int = 1


# Distance rings in km: (label, exclusive near edge, inclusive far edge).
RINGS = (
    ("intensity_0_10km", 0.0, 10.0),
    ("intensity_10_25km", 10.0, 25.0),
    ("intensity_25_50km", 25.0, 50.0),
    ("intensity_50_100km", 50.0, 100.0),
)

# Threshold grid of the episode-constrained choice.
EPISODE_THRESHOLDS = tuple(k / 100 for k in range(1, 21)) + (
    0.25, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.99,
)
# Threshold grid of the F1 sweep.
SWEEP_STEPS = 99
