"""Alert policy: signals, horizon consensus, debounced transitions, notification cooldown."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import DAY, RAIN_THRESHOLD, AlertPolicy
from .chunks import CHUNK, CORE, KEY, carry, core_only, micros, ordinal, running_total, spread_rows, with_chunk
from .lineage import cut

#: Longest chain of candidates that is folded as one array.
SHORT = 64
# Names of notifications.
RAIN_START, RAIN_RESUME, RAIN_STOP = "rain_start", "rain_resume", "rain_stop"
MODEL_ALERT, MODEL_CANCEL = "ml_alert", "ml_cancel"
RADAR_ALERT, RADAR_CANCEL = "radar_alert", "radar_cancel"


def signals(
    df: DataFrame, horizons: Sequence[int], thresholds: dict[int, float], onset_model: bool = False,
    p: str = "p_{h}m", policy: AlertPolicy = AlertPolicy(),
) -> DataFrame:
    """Per-horizon alerts, the consensus gate, the first alerting horizon and the message class.

    Needs ``rain_flag`` and, for onset models, ``rain_last_60m``.  A lone
    horizon below the required count clears every alert but no probability.
    """
    hs = sorted(horizons)
    raining = F.col("rain_flag") > RAIN_THRESHOLD
    eligible = ~raining & (F.col("rain_last_60m") <= RAIN_THRESHOLD) if onset_model else ~raining
    cols = {}
    for h in hs:
        hit = F.col(p.format(h=h)) >= thresholds[h]
        cols[f"signal_{h}m"] = hit
        cols[f"raw_alert_{h}m"] = F.coalesce(hit & eligible, F.lit(False))
        cols[f"suppressed_by_rain_{h}m"] = hit & raining
        cols[f"suppressed_by_antecedent_{h}m"] = (hit & ~F.coalesce(eligible, F.lit(False))) if onset_model else F.lit(False)
    df = df.withColumns(cols)
    count = sum((F.col(f"raw_alert_{h}m").cast("int") for h in hs), F.lit(0))
    need = min(policy.min_horizons, len(hs))
    df = df.withColumns({"is_raining": raining, "signal_count": count, "consensus": count >= need})
    kept = {f"alert_{h}m": F.col(f"raw_alert_{h}m") & F.col("consensus") for h in hs}
    df = df.withColumns(kept)
    first = F.coalesce(*[F.when(F.col(f"alert_{h}m"), F.lit(f"{h}m")) for h in hs])
    any_alert = (F.col("signal_count") > 0) & F.col("consensus")
    message = (
        F.when(any_alert, F.concat(F.lit("Rain alert in "), first))
        .when(raining & (F.col("signal_count") == 0), "Raining now; no advance rain alert").otherwise("No rain alert")
    )
    return df.withColumns({"any_alert": any_alert, "next_horizon": first, "alert_message": message})


def timeline(polls: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """Alert state at every poll and the notifications it asks for, before the cooldown.

    Input columns: station, ``ts``, ``wet`` (raw), ``alert`` (after consensus),
    ``radar`` (radar available, close class high enough and rising).  Every
    state is a function of a handful of previous polls, whatever their
    distance in time, so chunks are cut by row number.
    """
    df = ordinal(with_chunk(polls), [KEY], ["ts"], "_n").drop(CHUNK)
    reach = policy.dry_polls + max(policy.confirm_streak, policy.radar_streak) + 2
    df = spread_rows(df, reach, 0, "_n")
    w = Window.partitionBy(KEY, CHUNK).orderBy("_n")

    def all_true(c: str, n: int) -> Column:
        """The last ``n`` polls exist and all carry the flag."""
        frame = w.rowsBetween(-(n - 1), 0)
        return (F.count(c).over(frame) == n) & (F.min(c).over(frame) == 1)

    raining = F.max(F.col("wet").cast("int")).over(w.rowsBetween(-(policy.dry_polls - 1), 0))
    df = df.withColumn("_raining", raining)
    df = df.withColumns({
        "_model": (F.col("alert") & (F.col("_raining") == 0)).cast("int"),
        "_radar": (F.col("radar") & (F.col("_raining") == 0)).cast("int"),
    })
    df = df.withColumns({
        "_confirmed": all_true("_model", policy.confirm_streak).cast("int"),
        "_radar_confirmed": all_true("_radar", policy.radar_streak).cast("int"),
    })
    was = {c: F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("_raining", "_confirmed", "_radar_confirmed")}
    df = df.withColumns({f"_was{c}": col for c, col in was.items()})
    on = {c: F.col(c) == 1 for c in ("_raining", "_confirmed", "_radar_confirmed")}
    dry = ~on["_raining"]
    rises = {c: on[c] & (F.col(f"_was{c}") == 0) for c in on}
    falls = {c: ~on[c] & (F.col(f"_was{c}") == 1) for c in on}
    first_poll = F.col("_n") == 1
    rain = F.when(rises["_raining"], F.when(first_poll, RAIN_START).otherwise(RAIN_RESUME)).when(falls["_raining"], RAIN_STOP)
    model = F.when(rises["_confirmed"], MODEL_ALERT).when(falls["_confirmed"] & dry, MODEL_CANCEL)
    radar = F.when(rises["_radar_confirmed"], RADAR_ALERT).when(falls["_radar_confirmed"] & dry, RADAR_CANCEL)
    return core_only(df).select(
        KEY, "ts", (F.col("_raining") == 1).alias("raining"), on["_confirmed"].alias("confirmed_alert"),
        on["_radar_confirmed"].alias("confirmed_radar_alert"), F.array(rain, model, radar).alias("wants"),
    )


def notifications(states: DataFrame) -> DataFrame:
    """One row per wanted notification, in the order rain, model, radar within a poll."""
    return states.select(KEY, "ts", F.posexplode("wants").alias("seq", "kind")).filter(F.col("kind").isNotNull())


def cooldown_gate(wanted: DataFrame, cooldown: float, by: Sequence[str] = (KEY,), kind: str = "kind") -> DataFrame:
    """Add ``accepted``: drop a notification of the same kind as the last accepted one within the cooldown.

    Whatever happened before, a candidate is accepted if its predecessor has
    another kind (the last accepted one then has that kind) or is at least a
    cooldown older.  So the series falls apart into short chains at those
    points. Short chains are folded as arrays; longer ones, which a flapping
    sensor makes, are split by day.
    """
    by = list(by)
    us = F.unix_micros("ts")
    df = with_chunk(wanted).withColumn("_at", F.struct(us.alias("us"), F.col("seq").alias("seq")))
    df = carry(
        df, by, [F.max_by(F.struct(us.alias("us"), F.col(kind).alias("kind")), "_at").alias("_end")],
        {"_before": lambda w: F.lag("_end").over(w)},
    )
    w = Window.partitionBy(*by, CHUNK).orderBy("_at")
    prev = F.coalesce(F.lag(F.struct(us.alias("us"), F.col(kind).alias("kind"))).over(w), F.col("_before"))
    free = prev.isNull() | (prev["kind"] != F.col(kind)) | (us - prev["us"] >= micros(cooldown))
    df = df.withColumn("_free", free.cast("int"))
    df = running_total(df, by, ["_at"], F.col("_free"), "_chain")
    rows = cut(df.select(*by, "_chain", CHUNK, "_at.us", "_at.seq"), "candidates")
    sizes = rows.groupBy(*by, "_chain").agg(F.count(F.lit(1)).alias("_n"))
    graded = _short_chains(rows, by, cooldown)
    if sizes.filter(F.col("_n") > SHORT).take(1):
        sized = rows.join(sizes, [*by, "_chain"])
        graded = _short_chains(sized.filter(F.col("_n") <= SHORT), by, cooldown).unionByName(_long_chains(sized.filter(F.col("_n") > SHORT), by, cooldown))
    graded = graded.select(*by, F.timestamp_micros("us").alias("ts"), "seq", "accepted")
    return wanted.join(graded, [*by, "ts", "seq"])


def _short_chains(rows: DataFrame, by: list[str], cooldown: float) -> DataFrame:
    """Chains of at most ``SHORT`` candidates, each folded as an array."""
    chains = rows.groupBy(*by, "_chain").agg(F.sort_array(F.collect_list(F.struct("us", "seq"))).alias("ats"))
    start = F.struct(
        F.lit(None).cast("long").alias("last"),
        F.array().cast("array<struct<us:bigint,seq:int,ok:boolean>>").alias("out"))

    def step(acc, a):
        ok = acc["last"].isNull() | (a["us"] - acc["last"] >= micros(cooldown))
        row = F.struct(a["us"].alias("us"), a["seq"].alias("seq"), ok.alias("ok"))
        return F.struct(F.when(ok, a["us"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = chains.select(*by, F.explode(F.aggregate("ats", start, step, lambda s: s["out"])).alias("v"))
    return folded.select(*by, "v.us", "v.seq", F.col("v.ok").alias("accepted"))


def _long_chains(rows: DataFrame, by: list[str], cooldown: float) -> DataFrame:
    """Chains of any length, a day at a time.

    What a day makes of the last acceptance before it depends only on the first
    candidate it accepts, and that lies within one cooldown of the day's start.
    So a day is first summed up as a map from those candidates to its last
    acceptance, the maps of a chain are followed in order, and then every day is
    graded on its own.
    """
    wait = micros(cooldown)
    key = [*by, "_chain", CHUNK]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"{c} {kinds[c]}" for c in key)

    def follow(us: np.ndarray) -> np.ndarray:
        return np.searchsorted(us, us + wait)

    def sum_up(day: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(day["us"].to_numpy())
        after, last = follow(us), us.copy()
        for i in range(len(us) - 1, -1, -1):
            if after[i] < len(us):
                last[i] = last[after[i]]
        n = int(np.searchsorted(us, day[CHUNK].iloc[0] * DAY + wait)) + 1
        return pd.DataFrame([[*day[key].iloc[0], us[:n], last[:n]]], columns=[*key, "firsts", "lasts"])

    def walk(chain: pd.DataFrame) -> pd.DataFrame:
        now, out = None, []
        for row in chain.sort_values(CHUNK).itertuples(index=False):
            out.append(now)
            firsts, lasts = np.asarray(row[-2]), np.asarray(row[-1])
            i = 0 if now is None else int(np.searchsorted(firsts, now + wait))
            now = int(lasts[i]) if i < len(firsts) else now
        return chain.sort_values(CHUNK)[key].assign(before=pd.array(out, dtype="Int64"))

    def grade(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["us", "seq"])
        us, before = day["us"].to_numpy(), day["before"].iloc[0]
        after, ok = follow(us), np.zeros(len(day), bool)
        i = 0 if pd.isna(before) else int(np.searchsorted(us, int(before) + wait))
        while i < len(us):
            ok[i] = True
            i = max(after[i], i + 1)
        return day[[*by, "us", "seq"]].assign(accepted=ok)

    maps = rows.select(*key, "us").groupBy(*key).applyInPandas(sum_up, f"{head}, firsts array<long>, lasts array<long>")
    entries = maps.groupBy(*by, "_chain").applyInPandas(walk, f"{head}, before long")
    graded = ", ".join(f"{c} {kinds[c]}" for c in by) + ", us long, seq int, accepted boolean"
    return rows.join(entries, key).select(*key, "us", "seq", "before").groupBy(*key).applyInPandas(grade, graded)


def rising(value: str, order: str, by: Sequence[str], last: int, positive: bool, min_rows: int = 2) -> list[Column]:
    """Aggregates testing that the last ``last`` values of a group never fall and end above the start.

    The group is a handful of frames (or hours) by construction.
    """
    tail = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct(order, value)))), 1, last)
    values = F.transform(F.reverse(tail), lambda s: s[value])
    steps = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda a, b: a <= b)
    ok = (F.size(values) >= min_rows) & F.forall(steps, lambda x: x) & (F.element_at(values, -1) > F.element_at(values, 1))
    if positive:
        ok = ok & (F.element_at(values, -1) > 0)
    return [ok.alias("trend_rising")]
