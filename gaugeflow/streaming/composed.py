"""State machines over ordered micro-batches, each batch graded by many tasks.

A micro-batch is one more chunk of every station's history. What the history
before it means for the machine is a few rows a station: the last polls, the
last accepted notification, the start of an open rain event. These entries are
put before the batch, the batch operators (which cut a station into chunks and
carry state from chunk to chunk) run over both, and the rows of the entry are
taken out again. So nothing here walks a station's rows one by one, and the
result is that of the batch operator over the whole history.

Tables lie in folders named by micro-batch: a replay after a failure writes the
same folders again, and a later run with the same folder goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import rain_events as R
from ..operators.chunks import KEY, US
from ..operators.entities import drop_repeats
from ..operators.lineage import cut, fresh_path
from ..policy import RAIN_STOP_GAPS, AlertPolicy, GapRule, RainStopPolicy
from .ordered import in_order
from .run import PROVIDER, ROCKSDB, children, remove, watched

OLD = "_old"


class Entry:
    """Tables that one micro-batch leaves for the next: what each station's history amounts to."""

    def __init__(self, spark: SparkSession, folder: str, kinds: dict[str, str]):
        self.spark, self.folder, self.kinds = spark, folder, kinds

    def _versions(self, name: str, batch_id: int) -> list[int]:
        """Micro-batches before ``batch_id`` that left the table, in their order."""
        found = (int(p.split("=")[1]) for p in children(self.spark, f"{self.folder}/{name}"))
        return sorted(v for v in found if v < batch_id)

    def read(self, name: str, batch_id: int) -> DataFrame:
        past = self._versions(name, batch_id)
        if not past:
            return self.spark.createDataFrame([], self.kinds[name])
        return self.spark.read.schema(self.kinds[name]).parquet(f"{self.folder}/{name}/batch={past[-1]}")

    def write(self, name: str, batch_id: int, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")
        # A replay needs the entry that this batch read, never an older one.
        for old in self._versions(name, batch_id)[:-1]:
            remove(self.spark, f"{self.folder}/{name}/batch={old}")


def last_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows of each station; every task keeps no more before anything is shuffled."""
    w = Window.partitionBy(KEY).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def compose(ordered: DataFrame, step: Callable[[DataFrame, Entry, int], DataFrame], entries: dict[str, str], out: str, name: str, folder: str | None = None, whole: bool = False) -> DataFrame:
    """Run ``step`` over every micro-batch of an ordered stream; returns the landed table of schema ``out``.

    ``step`` gets the batch, the entries and the number of the batch; it writes
    the entries of the next batch itself. With ``whole`` it is an error if the
    engine drops a row as too late.
    """
    spark = ordered.sparkSession
    folder = folder or fresh_path(spark, name)
    entry = Entry(spark, folder, entries)

    def land(batch: DataFrame, batch_id: int) -> None:
        released = cut(batch, "released")
        if released.take(1):
            step(released, entry, batch_id).write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")
        elif batch_id == 0:
            spark.createDataFrame([], out).write.mode("overwrite").parquet(f"{folder}/table/batch=0")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        watched(ordered.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(land), name, whole)
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(f"{out}, batch long").option("basePath", f"{folder}/table").parquet(f"{folder}/table/*").drop("batch")


POLL = f"{KEY} long, ts timestamp, wet boolean, alert boolean, radar boolean"
SENT = f"{KEY} long, ts timestamp, seq int, kind string"
ALERTS = f"{KEY} long, ts timestamp, raining boolean, confirmed_alert boolean, confirmed_radar_alert boolean, notifications array<string>"


def alerts(polls: DataFrame, policy: AlertPolicy = AlertPolicy(), slot: float = 60.0, delay: str = "10 minutes", name: str = "alerts", folder: str | None = None, whole: bool = False) -> DataFrame:
    """State and accepted notifications at every poll (``wet``, ``alert``, ``radar`` flags), as the batch timeline gives them.

    The entry of a station is its last few polls and its last accepted
    notification: debounce and streaks look back no further, and the cooldown
    compares with nothing else. A null flag counts as the batch operator counts
    it; the times of a station are distinct.
    """
    reach = policy.dry_polls + max(policy.confirm_streak, policy.radar_streak) + 2

    def step(batch: DataFrame, entry: Entry, batch_id: int) -> DataFrame:
        past = entry.read("polls", batch_id)
        both = batch.select(*past.columns).unionByName(past)
        entry.write("polls", batch_id, last_rows(both, reach, "ts"))
        fresh = batch.groupBy(KEY).agg(F.min("ts").alias("_from"))
        states = cut(A.timeline(both, policy).join(fresh, KEY).filter("ts >= _from").drop("_from"), "states")
        sent = entry.read("sent", batch_id)
        wanted = A.notifications(states).unionByName(sent)
        graded = A.cooldown_gate(wanted, policy.cooldown).filter("accepted").drop("accepted")
        accepted = cut(graded, "accepted")
        entry.write("sent", batch_id, last_rows(accepted.select(*sent.columns), 1, "ts", "seq"))
        kinds = accepted.groupBy(KEY, "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda k: k["kind"]).alias("_kinds"))
        none = F.array().cast("array<string>")
        return states.drop("wants").join(kinds, [KEY, "ts"], "left").withColumn("notifications", F.coalesce("_kinds", none)).drop("_kinds")

    ordered = in_order(polls.select(KEY, "ts", "wet", "alert", "radar"), slot, delay)
    return compose(ordered, step, {"polls": POLL, "sent": SENT}, ALERTS, name, folder, whole)


def without_repeats(snapshots: DataFrame, hashed: str = "h", slot: float = 60.0, delay: str = "10 minutes", name: str = "repeats", folder: str | None = None, whole: bool = False) -> DataFrame:
    """Drop rows whose ``hashed`` equals that of the station's row before; the entry is the station's last row."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in snapshots.schema)

    def step(batch: DataFrame, entry: Entry, batch_id: int) -> DataFrame:
        past = entry.read("last", batch_id)
        both = batch.withColumn(OLD, F.lit(False)).unionByName(past.withColumn(OLD, F.lit(True)))
        entry.write("last", batch_id, last_rows(both.drop(OLD), 1, "ts"))
        return drop_repeats(both, "ts", F.col(hashed)).filter(~F.col(OLD)).drop(OLD)

    return compose(in_order(snapshots, slot, delay), step, {"last": kinds}, kinds, name, folder, whole)


READING = f"{KEY} long, ts timestamp, rain_flag double, open_us long"
SESSIONS = f"{KEY} long, start_us long, stop_us long"


def rain_sessions(readings: DataFrame, policy: RainStopPolicy = RainStopPolicy(), gaps: GapRule = RAIN_STOP_GAPS, slot: float = 60.0, delay: str = "10 minutes", name: str = "sessions", folder: str | None = None, whole: bool = False) -> DataFrame:
    """Rain events as they end (``stop_us`` null when a gap censored the event); rows without a rain flag are no readings.

    The entry of a station is the last ``dry_rows`` rows since its last gap and
    the start of the event still open, if any: an event that is open has a wet
    row among them.
    """

    def step(batch: DataFrame, entry: Entry, batch_id: int) -> DataFrame:
        past = entry.read("rows", batch_id)
        both = batch.filter(F.col("rain_flag").isNotNull() & ~F.isnan("rain_flag")).select(KEY, "ts", "rain_flag", F.lit(None).cast("long").alias("open_us")).unionByName(past)
        marked = cut(R._marked(both, policy, gaps), "marked")
        newest = marked.groupBy(KEY).agg(F.max(F.when(F.col("_start") == 1, F.col(US))).alias("_segment_us"))
        began = past.groupBy(KEY).agg(F.min("open_us").alias("_began"), F.max(F.unix_micros("ts")).alias("_seen"))
        events = R._events(marked).join(newest, KEY).join(began, KEY, "left")
        # The event that was open at the entry shows from its first row in the entry on.
        start: Column = F.when(F.col("start_us") <= F.col("_seen"), F.coalesce("_began", "start_us")).otherwise(F.col("start_us"))
        ended = F.col("complete") | (F.col("last_wet_us") < F.col("_segment_us"))
        events = cut(events.select(KEY, start.alias("start_us"), "stop_us", ended.alias("ended")), "events")
        still = events.filter("not ended").groupBy(KEY).agg(F.max("start_us").alias("_open"))
        kept = both.drop("open_us").join(newest, KEY).filter(F.unix_micros("ts") >= F.col("_segment_us")).drop("_segment_us")
        kept = last_rows(kept, policy.dry_rows, "ts").join(still, KEY, "left").withColumnRenamed("_open", "open_us")
        entry.write("rows", batch_id, kept.select(*past.columns))
        return events.filter("ended").select(KEY, "start_us", "stop_us")

    return compose(in_order(readings.select(KEY, "ts", "rain_flag"), slot, delay), step, {"rows": READING}, SESSIONS, name, folder, whole)
