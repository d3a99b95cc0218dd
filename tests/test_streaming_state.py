"""Ordered release, composed machines, settled outcomes, bridging and stored keys, in several micro-batches."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from helpers import at, frame, series, us
from pyspark.sql import functions as F
from test_events_alerts import _polls
from test_streaming import LAST, in_batches

from gaugeflow.operators import alerts as A
from gaugeflow.operators import rain_events as R
from gaugeflow.operators.asof import match_point
from gaugeflow.operators.segments import FILLED, TAIL, extend_tail
from gaugeflow.policy import LiveRule, MatchRule
from gaugeflow.streaming import composed as CP
from gaugeflow.streaming import ingest as I
from gaugeflow.streaming import storage as SG
from gaugeflow.streaming.bridge import EMITTED, bridge
from gaugeflow.streaming.ordered import in_order
from gaugeflow.streaming.run import drain, file_stream

POLL = "station_id long, ts timestamp, wet boolean, alert boolean, radar boolean"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("jitter, slot", [(0, 60.0), (400, 1800.0)])
def test_composed_alerts_equal_the_batch_timeline(spark, tmp_path, jitter, slot):
    df = spark.createDataFrame([(s, *p) for s in (0, 1) for p in _polls(s, 150)], POLL)
    live = CP.alerts(in_batches(spark, df, tmp_path, parts=3, jitter=jitter, last=True), slot=slot, folder=str(tmp_path / "run")).filter(f"station_id <> {LAST}")
    states = A.timeline(df)
    assert same(live.drop("notifications"), states.drop("wants"))
    sent = live.select("station_id", "ts", F.explode("notifications").alias("kind"))
    assert same(sent, A.cooldown_gate(A.notifications(states), 1800.0).filter("accepted").select("station_id", "ts", "kind"))


def test_composed_sessions_equal_the_batch_events(spark, tmp_path):
    """Events that stay open over micro-batches, close by dry rows or by a gap, and one still open at the end."""
    rows = series(3, 400, steps=(60, 60, 60, 151, 60), wet=0.2) + series(8, 300, steps=(60,), wet=0.3, station=1)
    df = frame(spark, rows).select("station_id", "ts", "rain_flag")
    live = {tuple(r) for r in CP.rain_sessions(in_batches(spark, df, tmp_path, parts=5, jitter=300, last=True), slot=600.0).collect() if r.station_id != LAST}
    events = R.rain_events(df).select("station_id", "start_us", "stop_us").collect()
    newest = {s: max(r.start_us for r in events if r.station_id == s) for s in (0, 1)}
    open_ = {tuple(r) for r in events if r.stop_us is None and r.start_us == newest[r.station_id]}
    assert {tuple(r) for r in events} - open_ <= live <= {tuple(r) for r in events} and len(live) > 10


def test_composed_repeats_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(s, at(60 * k), "ab"[(k // (3 + s)) % 2], k) for s in (0, 1) for k in range(60)], "station_id long, ts timestamp, h string, n int")
    live = CP.without_repeats(in_batches(spark, df, tmp_path, parts=4, jitter=200, last=True), slot=300.0).filter(f"station_id <> {LAST}")
    assert sorted((r.station_id, r.n) for r in live.collect()) == sorted((s, k) for s in (0, 1) for k in range(60) if k % (3 + s) == 0)


def test_composed_runs_go_on_in_their_folder(spark, tmp_path):
    rows = [(1, *p) for p in _polls(4, 100)]
    df = spark.createDataFrame(rows, POLL)
    first = sorted(rows, key=lambda r: r[1])[:60]
    folder = str(tmp_path / "run")
    spark.createDataFrame(first, POLL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema)
    assert 0 < CP.alerts(stream, folder=folder).count() < 60
    rest = sorted(rows, key=lambda r: r[1])[60:] + [(LAST, rows[-1][1] + timedelta(days=9), False, False, False)]
    spark.createDataFrame(rest, POLL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = CP.alerts(stream, folder=folder)
    assert same(live.drop("notifications"), A.timeline(df).drop("wants"))


def test_a_hot_station_is_released_by_many_tasks(spark, tmp_path):
    """A third of all rows in one station: its slots lie in several partitions, each handed on in order."""
    rows = [(0 if k % 3 == 0 else k, at(20 * k), float(k)) for k in range(1800)]
    df = spark.createDataFrame(rows, "station_id long, ts timestamp, v double")
    stream = in_batches(spark, df, tmp_path, parts=3, jitter=500, last=True)
    out = drain(in_order(stream, 600.0, "20 minutes").withColumn("part", F.spark_partition_id()), "ordered", machine=True, whole=True)
    hot = out.filter("station_id = 0")
    assert hot.count() == 600 and hot.select("part").distinct().count() > 1
    assert same(out.filter(f"station_id <> {LAST}").drop("part"), df)


def test_rows_without_a_station_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(None, at(0), 1.0)], "station_id long, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="station or time"):
        drain(in_order(file_stream(spark, str(tmp_path / "in"), df.schema)), "ordered", machine=True)


FORECAST = "station_id long, issued_at timestamp, valid_at timestamp, lead_minutes int, rain_prob double, source_layer string"


def test_every_matured_forecast_comes_out_once(spark, tmp_path):
    """Unmatched and doubly matched forecasts, readings at slot edges, in several micro-batches of both streams."""
    rule = MatchRule(max_lead=30)
    rows = [(s, at(60 * k), at(60 * k + lead * 60 + (k * 37) % 60), lead, 0.5, "a") for s in (0, 1) for k in range(0, 600, 7) for lead in (5, 30)]
    f = spark.createDataFrame(rows, FORECAST)
    times = [t for t in range(0, 40_000, 47) if (t // 1000) % 3]
    r = spark.createDataFrame([(s, at(t + s), 1.0 if t % 5 == 0 else 0.0) for s in (0, 1) for t in times], "station_id long, ts timestamp, rain_flag double")
    for name, df, order, parts in (("f", f, "valid_at", 3), ("r", r, "ts", 4)):
        listed = sorted(df.collect(), key=lambda x: x[order])
        size = -(-len(listed) // parts)
        for i in range(parts):
            spark.createDataFrame(listed[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(0.02)
    streams = [file_stream(spark, str(tmp_path / n), d.schema, maxFilesPerTrigger=1) for n, d in (("f", f), ("r", r))]
    out = drain(I.settled_outcomes(*streams, delay=60.0, rule=rule), "settled", whole=True)
    mature = min(max(x.valid_at for x in f.collect()), max(x.ts for x in r.collect())) - timedelta(seconds=60 + 30 * 60 + 90 + 600)
    want = match_point(f, r, rule=rule).filter(F.col("valid_at") <= F.lit(mature)).select("station_id", "valid_at", "lead_minutes", "actual")
    got = out.filter(F.col("valid_at") <= F.lit(mature)).select(want.columns)
    assert want.count() > 200 and same(got, want)
    assert {x.actual for x in want.collect()} == {0, 1, None}
    assert out.count() < f.count()  # the last ones have not matured


def test_a_silent_station_is_bridged_by_the_clock(spark, tmp_path):
    """Stand-ins come while nothing arrives, a step apart, and end with the silence or when it has lasted too long."""
    rule = LiveRule(fresh=2.0, bridged=9.0, step=1.0, slack=0.5)
    start = datetime.now(timezone.utc).replace(microsecond=0)
    schema = "station_id long, ts timestamp, temp double, note string"
    spark.createDataFrame([(1, start, 20.5, "a"), (1, start - timedelta(seconds=5), 9.0, "old"), (2, start - timedelta(seconds=60), 1.0, None)], schema).write.parquet(str(tmp_path / "in"))
    out, before = str(tmp_path / "out"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        query = bridge(stream, rule).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").foreachBatch(
            lambda b, i: b.write.mode("append").parquet(out)).start()
        time.sleep(max(0.0, 13.0 - (datetime.now(timezone.utc) - start).total_seconds()))
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.parquet(out).collect()
    made = sorted((r for r in rows if r[TAIL] == 1.0), key=lambda r: r.ts)
    assert len([r for r in rows if r[TAIL] == 0.0]) == 3
    assert made and {(r.station_id, r.temp, r.note, r[FILLED]) for r in made} == {(1, 20.5, "a", 1.0)}
    offsets = [(us(r.ts) - us(start)) // 1_000_000 for r in made]
    assert offsets == list(range(1, len(made) + 1)) and max(offsets) <= 8
    # No copy is made before its time, within the first silence, or after the last.
    assert all(r[EMITTED] - r.ts >= timedelta(seconds=0.5) for r in made)
    late = [us(r[EMITTED]) - us(start) for r in made]
    assert min(late) > 2_000_000 and max(late) <= 9_000_000


@pytest.mark.parametrize("age", [100, 400, 600, 601])
def test_bridge_at_a_time_equals_the_extended_tail(spark, tmp_path, age):
    df = spark.createDataFrame([(s, at(60 * k + s), float(k)) for s in (0, 1) for k in range(4)], "station_id long, ts timestamp, temp double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    now = at(181 + age)
    now_ms = us(now) // 1000
    live = drain(bridge(file_stream(spark, str(tmp_path / "in"), df.schema), clock=lambda _: now_ms), "bridged", machine=True, clock=True)
    assert same(live.drop(EMITTED), extend_tail(df, F.lit(now)).select(live.drop(EMITTED).columns))


def test_stored_keys_are_read_from_one_version_a_date(spark, tmp_path):
    """Many micro-batches on the same dates: the first arrival stays, and each date keeps its newest versions only."""
    rows = [(k % 2, at(3600 * (k * 37 % 40)), k, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "station_id long, ts timestamp, arrived int, v double")
    for i in range(8):
        df.filter(F.col("arrived").between(25 * i, 25 * i + 24)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stored = SG.store_unique(stream, out, state, arrival=("arrived",), buckets=4)
    want = {}
    for s, ts, k, v in rows:
        want.setdefault((s, us(ts)), v)
    assert {(r.station_id, us(r.ts)): r.v for r in stored.collect()} == want and stored.count() == len(want)
    versions = [list((p / "x").parent.glob("version=*")) for p in (tmp_path / "out" / "keys").glob("date=*")]
    assert versions and max(map(len, versions)) <= 2
    keys = SG.KeyStore(spark, out, "ts", 4)
    plan = df.repartition(4, "station_id", "ts").join(keys.known([str(at(0).date())], 99), ["station_id", "ts"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the stored side is read in place
    df.limit(10).withColumn("arrived", F.lit(999)).write.mode("append").parquet(str(tmp_path / "in"))
    assert SG.store_unique(stream, out, state, arrival=("arrived",), buckets=4).count() == len(want)


def test_first_arrival_is_told_by_file_and_row(spark, tmp_path):
    for v in (1.0, 2.0, 3.0):
        spark.createDataFrame([(0, at(0), v), (0, at(0), v + 0.5)], "station_id long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = SG.arrivals(file_stream(spark, str(tmp_path / "in"), "station_id long, ts timestamp, v double"))
    stored = SG.store_unique(stream, str(tmp_path / "out"), str(tmp_path / "state"), arrival=SG.ARRIVAL)
    assert [r.v for r in stored.collect()] == [1.0] and stored.columns == ["station_id", "ts", "v"]
