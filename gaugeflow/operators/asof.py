"""Time joins between readings and forecasts: as-of, nearest, point match, window match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import DAY, MINUTE, RAIN_THRESHOLD, MatchRule
from .chunks import CHUNK, KEY, US, bucket, carry, micros


def asof_known(readings: DataFrame, log: DataFrame, payload: Sequence[str], span: int = DAY, oldest: float = 6 * 3600.0) -> DataFrame:
    """For each reading the newest valid forecast row already issued and valid by then.

    Both sides meet in one union keyed by the time a row becomes eligible
    (``greatest(issued_at, valid_at)`` for forecasts), so this is a sort and a
    running maximum instead of a two-inequality join.  The maximum of earlier
    chunks is carried in per (station, chunk): a forecast log with holes of
    any length stays exact and no station needs a single task. A forecast valid
    more than ``oldest`` seconds before the reading counts as none; the newest
    valid one decides, so no other could be younger.
    """
    reading_cols = [c for c in readings.columns if c not in (KEY, "ts")]
    offer = F.struct(
        F.unix_micros("valid_at").alias("valid_us"), F.unix_micros("issued_at").alias("issued_us"),
        *[F.col(c) for c in payload],
    )
    left = readings.select(
        KEY, F.unix_micros("ts").alias(US), F.struct("ts", *reading_cols).alias("_row"),
        F.lit(1).alias("_side"),
    )
    right = log.select(
        KEY, F.greatest(F.unix_micros("issued_at"), F.unix_micros("valid_at")).alias(US), offer.alias("_offer"),
        F.lit(0).alias("_side"),
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn(CHUNK, bucket(F.col(US), span))
    both = carry(
        both, [KEY], [F.max("_offer").alias("_m")],
        {"_carried": lambda w: F.max("_m").over(w.rowsBetween(Window.unboundedPreceding, -1))},
    )
    w = Window.partitionBy(KEY, CHUNK).orderBy(US, "_side").rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest(F.col("_carried"), F.max("_offer").over(w))
    best = F.when(F.col(US) - best["valid_us"] <= micros(oldest), best)
    out = both.withColumn("_best", best).filter("_side = 1")
    age = (F.col(US) - F.col("_best.issued_us")) / 1e6
    return out.select(
        KEY, "_row.*",
        F.timestamp_micros("_best.valid_us").alias("nwp_valid_at"),
        F.timestamp_micros("_best.issued_us").alias("nwp_issued_at"),
        *[F.col(f"_best.{c}").alias(f"nwp_{c}") for c in payload],
        F.when(F.col("_best").isNotNull(), 1.0).alias("nwp_available"),
        F.greatest(age, F.lit(0.0)).alias("nwp_age_seconds"),
    )


def nearest_within(
    left: DataFrame, left_ts: str, right: DataFrame, right_ts: str, value: str, tolerance: float, span: int = DAY
) -> DataFrame:
    """Value of the nearest right row within ``tolerance`` seconds; equal distances take the earlier.

    Adds ``value`` (null without a match) and ``matched_at`` to ``left``.
    """
    cols = [c for c in left.columns if c != KEY]
    l = left.select(KEY, F.col(left_ts).alias("ts"), F.struct(*cols).alias("_row"))
    r = right.filter(F.col(value).isNotNull()).select(
        KEY, F.col(right_ts).alias("ts"),
        F.struct(F.unix_micros(F.col(right_ts)).alias("us"), F.col(value).alias("v")).alias("_obs"),
    )
    # Left rows stay in their own chunk; only observations near an edge are copied.
    both = l.unionByName(r, allowMissingColumns=True)
    reach = F.when(F.col("_obs").isNotNull(), micros(tolerance)).otherwise(0)
    us = F.unix_micros("ts")
    both = both.withColumn(US, us).withColumn(
        CHUNK, F.explode(F.sequence(bucket(F.col(US) - reach, span), bucket(F.col(US) + reach, span)))
    )
    # Two running frames, one per direction: a frame reaching to the end of the
    # partition would be rescanned for every row.
    up = Window.partitionBy(KEY, CHUNK).orderBy(US).rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(KEY, CHUNK).orderBy(F.col(US).desc()).rangeBetween(Window.unboundedPreceding, 0)
    before = F.last("_obs", ignorenulls=True).over(up)
    after = F.last("_obs", ignorenulls=True).over(down)
    both = both.withColumn("_b", before).withColumn("_a", after).filter(F.col("_row").isNotNull())
    db, da = F.col(US) - F.col("_b.us"), F.col("_a.us") - F.col(US)
    pick = F.when(F.col("_a").isNull() | (db <= da), F.col("_b")).otherwise(F.col("_a"))
    both = both.withColumn("_pick", pick)
    near = F.abs(F.col("_pick.us") - F.col(US)) <= micros(tolerance)
    return both.select(
        KEY, "_row.*", F.when(near, F.col("_pick.v")).alias(value),
        F.when(near, F.timestamp_micros("_pick.us")).alias("matched_at"),
    )


def match_point(
    forecasts: DataFrame, readings: DataFrame, at: str = "valid_at", rule: MatchRule = MatchRule(),
    id_cols: Sequence[str] = (KEY, "issued_at", "lead_minutes", "source_layer"),
) -> DataFrame:
    """Nearest reading to each forecast's valid time, searched in three minute buckets.

    The buckets are the valid minute, the one before and the one after, so a
    reading inside the tolerance can still be out of reach, as specified.
    Equal distances prefer the bucket order (same, before, after), then time.
    Adds ``actual`` (0/1, null without a match).
    """
    at_us = F.unix_micros(F.col(at))
    probes = forecasts.select(*id_cols, at_us.alias("_at")).withColumn(
        "_probe", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(d).alias("step")) for k, d in enumerate((0, -1, 1))]))
    ).withColumn("_minute", bucket(F.col("_at"), MINUTE) + F.col("_probe.step"))
    r = readings.select(KEY, F.unix_micros("ts").alias("_rus"), "rain_flag").withColumn("_minute", bucket(F.col("_rus"), MINUTE))
    hits = probes.join(r, [KEY, "_minute"])
    best = hits.groupBy(*id_cols).agg(
        F.min(F.struct(F.abs(F.col("_rus") - F.col("_at")).alias("d"), F.col("_probe.rank").alias("rank"),
                       F.col("_rus").alias("us"), F.col("rain_flag").alias("rain"))).alias("_m")
    )
    wet = F.when(F.col("_m.d") <= micros(rule.point_tolerance), (F.col("_m.rain") > RAIN_THRESHOLD).cast("int"))
    return forecasts.join(best.select(*id_cols, wet.alias("actual")), list(id_cols), "left")


def _slot_fold(slots: Column, lead: Column) -> Column:
    """Greedy one-to-one match over slots 1..lead; null unless each slot gets its own reading.

    A reading can belong to two slots only when it lies exactly on their
    common edge, so the only state is whether the previous slot used its upper
    edge reading.  Slot fields: k, inner (closest strictly inside), low and
    high (readings exactly on the edges), each a wet flag or null.
    """
    start = F.struct(F.lit(0).alias("k"), F.lit(True).alias("ok"), F.lit(False).alias("wet"), F.lit(False).alias("used"))

    def step(acc, s):
        low = F.when(~acc["used"], s["low"])
        chosen = F.coalesce(s["inner"], low, s["high"])
        used = s["inner"].isNull() & low.isNull() & s["high"].isNotNull()
        ok = acc["ok"] & (s["k"] == acc["k"] + 1) & chosen.isNotNull()
        return F.struct(
            s["k"].alias("k"), ok.alias("ok"),
            (acc["wet"] | F.coalesce(chosen, F.lit(False))).alias("wet"), used.alias("used"),
        )

    reached = F.filter(slots, lambda s: s["k"] <= lead)
    return F.aggregate(reached, start, step, lambda a: F.when(a["ok"] & (a["k"] == lead), a["wet"].cast("int")))


def match_window(
    forecasts: DataFrame, readings: DataFrame, rule: MatchRule = MatchRule(), block: int = 30 * MINUTE,
) -> DataFrame:
    """Rain-in-window label that demands a distinct reading near every minute of the lead.

    Readings are packed per (station, half hour) once; each distinct
    (station, issue time) joins the few packs its longest lead touches, and all
    leads of that issue are folded from the same slot list.  Adds ``actual``.
    """
    tol = micros(rule.window_tolerance)
    if 2 * tol > MINUTE:
        raise ValueError("window tolerance above half a minute would let slots overlap")
    r = readings.select(
        KEY, F.unix_micros("ts").alias("us"), (F.col("rain_flag") > RAIN_THRESHOLD).alias("wet")
    ).withColumn("_block", bucket(F.col("us"), block))
    packs = r.groupBy(KEY, "_block").agg(F.collect_list(F.struct("us", "wet")).alias("pack"))

    valid = forecasts.filter((F.col("lead_minutes") > 0) & (F.col("valid_at") > F.col("issued_at")))
    issues = valid.groupBy(KEY, "issued_at").agg(
        F.max("lead_minutes").alias("_lead"), F.max(F.unix_micros("valid_at")).alias("_end"))
    issued = F.unix_micros("issued_at")
    wanted = issues.withColumn(
        "_block", F.explode(F.sequence(bucket(issued, block), bucket(F.col("_end") + tol, block)))
    )
    joined = wanted.join(packs, [KEY, "_block"])
    # Offsets from the issue time; slot k is the minute k with +-tolerance.
    near = joined.select(
        KEY, "issued_at",
        F.filter("pack", lambda p: (p["us"] > issued) & (p["us"] <= F.col("_end") + tol)).alias("pack"),
    )
    one = near.groupBy(KEY, "issued_at").agg(F.flatten(F.collect_list("pack")).alias("pack"))
    placed = F.flatten(F.transform("pack", lambda p: _places(p, issued, tol)))
    slots = one.select(KEY, "issued_at", F.explode(placed).alias("s")).groupBy(KEY, "issued_at", "s.k").agg(
        # ties inside a slot take the earlier reading
        F.min(F.when(F.col("s.edge") == 0, F.struct("s.d", "s.us", "s.wet"))).alias("_in"),
        F.max(F.when(F.col("s.edge") == -1, F.col("s.wet"))).alias("low"),
        F.max(F.when(F.col("s.edge") == 1, F.col("s.wet"))).alias("high"),
    )
    lists = slots.groupBy(KEY, "issued_at").agg(
        F.sort_array(F.collect_list(F.struct(F.col("k"), F.col("_in.wet").alias("inner"), "low", "high"))).alias("slots")
    )
    graded = valid.select(KEY, "issued_at", "lead_minutes", "source_layer").join(lists, [KEY, "issued_at"], "left").select(
        KEY, "issued_at", "lead_minutes", "source_layer", _slot_fold(F.col("slots"), F.col("lead_minutes")).alias("actual")
    )
    return forecasts.join(graded, [KEY, "issued_at", "lead_minutes", "source_layer"], "left")


def _places(p: Column, issued: Column, tol: int) -> Column:
    """Slot memberships of one reading: inside one slot, or on the edge of two."""
    off = p["us"] - issued + F.lit(tol)
    k = F.floor(off / float(MINUTE)).cast("int")
    inside = off - k * MINUTE  # 0..MINUTE, equal to 0 on the lower edge
    edge_pair = F.lit(tol * 2 == MINUTE) & (inside == 0)

    def place(slot: Column, edge: Column) -> Column:
        d = F.abs(inside - F.lit(tol))
        return F.struct(slot.alias("k"), edge.alias("edge"), d.alias("d"), p["us"].alias("us"), p["wet"].alias("wet"))

    return F.filter(
        F.when(edge_pair, F.array(place(k - 1, F.lit(1)), place(k, F.lit(-1))))
        .otherwise(F.array(place(k, F.lit(0)))),
        lambda s: (s["k"] >= 1) & (s["d"] <= tol),
    )
