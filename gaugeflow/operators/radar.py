"""Rain fields on a pixel grid: distance rings, motion between frames, arrival at a sensor.

Pixels are a long sparse table ``(frame_time, x, y, bucket)`` per ``by`` key
(a sensor or region); absent pixels are class 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.geo import bearing
from ..policy import GridPolicy, RINGS
from .alerts import rising


def ring_maxima(pixels: DataFrame, by: Sequence[str], cx: Column, cy: Column, meters_per_pixel: Column, rings=RINGS,
                home: tuple | None = None) -> DataFrame:
    """Strongest class per ring and at the sensor pixel, per frame (map-side combinable).

    ``home`` = (x0, x1, y0, y1) half-open bounds of the home tile.
    """
    dx, dy = F.col("x") - cx, F.col("y") - cy
    km = F.sqrt((dx * dx + dy * dy).cast("double")) * meters_per_pixel / 1000.0

    def strongest(where: Column) -> Column:
        return F.coalesce(F.max(F.when(where, F.col("bucket"))), F.lit(0))

    aggs = [strongest((km > near) & (km <= far)).alias(label) for label, near, far in rings]
    aggs.append(strongest((dx == 0) & (dy == 0)).alias("point_intensity"))
    if home:
        x0, x1, y0, y1 = home
        aggs.append(strongest((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).alias("nearby_max_intensity"))
    out = pixels.groupBy(*by, "frame_time").agg(*aggs)
    return out.withColumn("close_max_intensity", F.greatest(F.col(rings[0][0]), F.col(rings[1][0])))


def ring_trend(rings: DataFrame, by: Sequence[str], frames: int = GridPolicy().ring_frames) -> DataFrame:
    """Whether the close class rises over the last frames, with the newest frame's classes."""
    cols = [c for c in rings.columns if c not in (*by, "frame_time")]
    trend = rising("close_max_intensity", "frame_time", by, frames, positive=True)
    out = rings.groupBy(*by).agg(F.max("frame_time").alias("frame_time"), F.max_by(F.struct(*cols), "frame_time").alias("_r"), *trend)
    return out.select(*by, "frame_time", "_r.*", "trend_rising")


def crop(pixels: DataFrame, cx: Column, cy: Column, grid: GridPolicy = GridPolicy()) -> DataFrame:
    """Pixels in the motion window around the sensor, in window coordinates.

    Keeps each frame at most ``window`` squared pixels, the bound every later
    step relies on.
    """
    half = grid.window // 2
    x0, y0 = F.greatest(cx - half, F.lit(0)), F.greatest(cy - half, F.lit(0))
    inside = (F.col("x") >= x0) & (F.col("x") < cx + half) & (F.col("y") >= y0) & (F.col("y") < cy + half)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


#: Pixels of a word of a scan line.
WORD = 64


def shifted(words: Sequence[str], by: int) -> list[Column]:
    """The words of a line moved ``by`` pixels (less than a word) to higher x, or to lower x if negative."""
    out = []
    for i, w in enumerate(words):
        if by >= 0:
            moved, rest = F.shiftleft(w, by), F.shiftrightunsigned(words[i - 1], WORD - by) if by and i else None
        else:
            moved, rest = F.shiftrightunsigned(w, -by), F.shiftleft(words[i + 1], WORD + by) if i + 1 < len(words) else None
        out.append(moved if rest is None else moved.bitwiseOR(rest))
    return out


def motion(pixels: DataFrame, by: Sequence[str], frames: DataFrame, grid: GridPolicy = GridPolicy()) -> DataFrame:
    """Best pixel shift per consecutive frame pair.

    A scan line becomes a few words of 64 pixels, one bit a wet pixel (a line is
    at most ``window`` long). Lines of a frame meet the lines of the next frame
    once per vertical shift by equi-join; a horizontal shift moves the words,
    and the overlap is the number of bits that both have. So the work is lines
    x shifts, not wet pixels x wet pixels, and a met pair of lines is one row
    with a sum per shift. ``frames`` lists all
    frame times, so an empty frame still breaks its pairs; the newest
    ``grid.frames`` of them count.  Ties prefer no shift, then the smaller dy,
    then the smaller dx.  Pixels are in window coordinates (see ``crop``).
    """
    if grid.max_shift >= WORD:
        raise ValueError(f"a shift is less than {WORD} pixels")
    by = list(by)
    keys = by or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy("frame_time")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("frame_time").desc()))
    used = frames.select(*by, "frame_time").distinct().withColumn("_k", newest).filter(F.col("_k") <= grid.frames).drop("_k")
    pairs = used.withColumn("next_time", F.lead("frame_time").over(w))
    pairs = pairs.filter(F.col("next_time") > F.col("frame_time"))
    wet = pixels.filter(F.col("bucket") >= grid.wet_class)
    n_words = -(-grid.window // WORD)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("x", F.lit(WORD)).cast("int"))
    here_, there_ = [f"_w{i}" for i in range(n_words)], [f"_v{i}" for i in range(n_words)]
    word = F.floor(F.col("x") / WORD)
    lines = wet.groupBy(*by, "frame_time", "y").agg(*[F.coalesce(F.bit_or(F.when(word == i, bit)), F.lit(0).cast("long")).alias(w) for i, w in enumerate(here_)])
    steps = range(-grid.max_shift, grid.max_shift + 1, grid.shift_step)
    here = lines.join(pairs, [*by, "frame_time"]).withColumn("dy", F.explode(F.array(*[F.lit(k) for k in steps]))).withColumn("_y", F.col("y") + F.col("dy"))
    there = lines.select(*by, F.col("frame_time").alias("next_time"), F.col("y").alias("_y"), *[F.col(w).alias(v) for w, v in zip(here_, there_)])
    met = here.join(there, [*by, "next_time", "_y"])
    sums = [F.sum(sum((F.bit_count(w.bitwiseAND(F.col(v))) for w, v in zip(shifted(here_, k), there_)), F.lit(0))).alias(f"_n{i}") for i, k in enumerate(steps)]
    summed = met.groupBy(*by, "frame_time", "next_time", "dy").agg(*sums)
    each = F.array(*[F.struct(F.lit(k).alias("dx"), F.col(f"_n{i}").alias("n")) for i, k in enumerate(steps)])
    totals = summed.select(*by, "frame_time", "next_time", "dy", F.explode(each).alias("h")).select(*by, "frame_time", "next_time", "dy", "h.dx", "h.n").filter(F.col("n") > 0)
    moved = (F.col("dx") != 0) | (F.col("dy") != 0)
    order = F.struct(-F.col("n"), moved.cast("int"), F.col("dy"), F.col("dx"))
    best = totals.groupBy(*by, "frame_time", "next_time").agg(F.min_by(F.struct("dx", "dy", "n"), order).alias("b"))
    # Both frames wet but no overlap at any shift means no motion; an empty frame skips the pair.
    seen = wet.select(*by, "frame_time").distinct()
    both = pairs.join(seen, [*by, "frame_time"], "left_semi").join(
        seen.withColumnRenamed("frame_time", "next_time"), [*by, "next_time"], "left_semi")
    return both.join(best, [*by, "frame_time", "next_time"], "left").select(
        *by, "frame_time", "next_time", F.coalesce("b.dx", F.lit(0)).alias("dx"), F.coalesce("b.dy", F.lit(0)).alias("dy"),
        F.coalesce("b.n", F.lit(0)).alias("overlap"))


def velocity(shifts: DataFrame, by: Sequence[str], frame_count: Column | int, meters_per_pixel: Column) -> DataFrame:
    """Mean motion in pixels per minute with bearing, speed and consistency of the pairs.

    ``frame_time`` is in seconds.
    """
    minutes = (F.col("next_time") - F.col("frame_time")) / 60.0
    v = shifts.withColumns({"_vx": F.col("dx") / minutes, "_vy": F.col("dy") / minutes})
    out = v.groupBy(*by).agg(
        F.avg("_vx").alias("vx"), F.avg("_vy").alias("vy"), F.count(F.lit(1)).alias("pairs"),
        (F.stddev_pop("_vx") + F.stddev_pop("_vy")).alias("_spread"))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    even = F.when(F.col("pairs") >= 2, F.greatest(F.lit(0.0), 1.0 - F.col("_spread") / F.greatest(speed, F.lit(1e-6)))).otherwise(0.5)
    share = F.col("pairs") / ((F.lit(frame_count) if isinstance(frame_count, int) else frame_count) - 1)
    return out.withColumns({
        "speed": speed, "motion_kmh": rounded(speed * meters_per_pixel / 1000.0 * 60.0, 1),
        "motion_deg": bearing(F.col("vx"), F.col("vy")),
        "confidence": rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), even * share)), 2),
    }).drop("_spread")


def arrival(latest: DataFrame, velocities: DataFrame, by: Sequence[str], sx: Column, sy: Column, width: Column, height: Column,
            grid: GridPolicy = GridPolicy()) -> DataFrame:
    """First look-ahead step at which upstream rain reaches the sensor.

    ``latest`` holds the newest frame's pixels in window coordinates; the scan
    stops at the first step that leaves the window.
    """
    by = list(by)
    steps = F.explode(F.sequence(F.lit(0), F.lit(grid.lookahead), F.lit(grid.lookahead_step)))
    v = velocities.withColumn("t", steps)
    v = v.withColumns({
        "x": F.bround(sx - F.col("vx") * F.col("t"), 0).cast("int"), "y": F.bround(sy - F.col("vy") * F.col("t"), 0).cast("int")})
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= width) | (F.col("y") >= height)
    v = v.withColumn("_out", outside)
    hits = v.join(latest.filter(F.col("bucket") >= grid.wet_class).select(*by, "x", "y", "bucket"), [*by, "x", "y"], "left")
    facts = [c for c in velocities.columns if c not in by]
    out = hits.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in facts], F.min(F.when(F.col("_out"), F.col("t"))).alias("_edge"),
        F.min(F.when(~F.col("_out") & F.col("bucket").isNotNull(), F.struct("t", "bucket"))).alias("_hit"))
    found = F.col("_hit").isNotNull() & (F.col("_edge").isNull() | (F.col("_hit.t") < F.col("_edge"))) & (F.col("speed") > 1e-6)
    return out.select(
        *by, *facts, F.coalesce(found, F.lit(False)).alias("rain_arriving"), F.when(found, F.col("_hit.t")).alias("eta_minutes"),
        F.when(found, F.col("_hit.bucket")).alias("expected_intensity"))


def outlook(pixels: DataFrame, frames: DataFrame, velocities: DataFrame, by: Sequence[str], sx: Column, sy: Column, width: Column, height: Column,
            grid: GridPolicy = GridPolicy()) -> DataFrame:
    """Arrival for every region of ``frames``.

    Where the newest frame is dry, or no pair of frames can be tracked, nothing
    arrives: no motion, confidence 0.
    """
    by = list(by)
    newest = frames.groupBy(*by).agg(F.max("frame_time").alias("frame_time"))
    latest = pixels.join(newest, [*by, "frame_time"])
    wet = latest.filter(F.col("bucket") >= grid.wet_class).select(*by).distinct()
    moving = arrival(latest, velocities.join(wet, by, "left_semi"), by, sx, sy, width, height, grid)
    out = newest.drop("frame_time").join(moving, by, "left")
    return out.withColumns({"rain_arriving": F.coalesce("rain_arriving", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0))})
