"""Streams processed in several micro-batches must give what the batch operators give."""

import os
import random
import time
from datetime import timedelta

import pytest
from helpers import at, frame, series, us
from pyspark.sql import functions as F

from gaugeflow.operators import alerts as A
from gaugeflow.operators import rain_events as R
from gaugeflow.operators.lineage import cut
from gaugeflow.operators.revision import compare_issues
from gaugeflow.plans import load_queries
from gaugeflow.streaming import ingest as I
from gaugeflow.streaming import revisions as RV
from gaugeflow.streaming import run
from gaugeflow.streaming import stateful as ST
from gaugeflow.streaming.run import drain, file_stream
from test_events_alerts import _polls


LAST = 99  # a station whose one late row moves the watermark past all others


def in_batches(spark, df, path, parts=3, jitter=0, last=False):
    """Land a frame as consecutive files, one per micro-batch, in time order or up to ``jitter`` seconds off it."""
    rng = random.Random(1)
    rows = sorted(df.collect(), key=lambda r: r.ts.timestamp() + rng.uniform(0, jitter))
    size = -(-len(rows) // parts)
    batches = [rows[i * size: (i + 1) * size] for i in range(parts)]
    if last:
        end = max(rows, key=lambda r: r.ts)
        batches.append([end.asDict() | {"station_id": LAST, "ts": end.ts + timedelta(days=1)}])
    for i, batch in enumerate(batches):
        part = str(path / f"part{i}")
        spark.createDataFrame(batch, df.schema).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(path / "in", exist_ok=True)
        with open(f"{part}/{file}", "rb") as src, open(path / "in" / f"{i}.parquet", "wb") as dst:
            dst.write(src.read())
        os.utime(path / "in" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return file_stream(spark, str(path / "in"), df.schema, maxFilesPerTrigger=1)


@pytest.mark.parametrize("jitter", [0, 400])
def test_alert_stream_equals_batch_timeline(spark, tmp_path, jitter):
    df = spark.createDataFrame([(s, *p) for s in (0, 1) for p in _polls(s, 150)], "station_id long, ts timestamp, wet boolean, alert boolean, radar boolean")
    live = drain(ST.alerts(in_batches(spark, df, tmp_path, jitter=jitter, last=True)), "alerts", machine=True).filter(f"station_id <> {LAST}")
    states = A.timeline(df)
    cols = ["station_id", "ts", "raining", "confirmed_alert", "confirmed_radar_alert"]
    assert live.select(cols).exceptAll(states.select(cols)).count() == 0 and live.count() == df.count()
    sent = live.select("station_id", "ts", F.explode("notifications").alias("kind"))
    want = A.cooldown_gate(A.notifications(states), 1800.0).filter("accepted").select("station_id", "ts", "kind")
    assert sent.exceptAll(want).count() == 0 and want.exceptAll(sent).count() == 0


@pytest.mark.parametrize("jitter", [0, 400])
def test_rain_session_stream_equals_batch_events(spark, tmp_path, jitter):
    df = frame(spark, series(3, 400, steps=(60, 60, 60, 151, 60), wet=0.2)).select("station_id", "ts", "rain_flag")
    live = {(r.start_us, r.stop_us) for r in drain(ST.rain_sessions(in_batches(spark, df, tmp_path, jitter=jitter, last=True)), "sessions", machine=True).collect() if r.station_id != LAST}
    events = [(r.start_us, r.stop_us) for r in R.rain_events(df).orderBy("start_us").collect()]
    assert live == set(events) or live == set(events[:-1])  # the newest event may still be open


def test_dedupe_drops_repeats_across_batches(spark, tmp_path):
    rows = [(0, at(60 * (i // 2)), 1.0, 50.0, 1000.0, 0.0) for i in range(40)]
    out = drain(I.unique_readings(in_batches(spark, frame(spark, rows), tmp_path)), "unique")
    assert out.count() == 20


def test_late_and_future_rows_are_refused(spark):
    df = spark.createDataFrame([(at(0),), (at(821),), (at(1061),)], "ts timestamp")
    now = F.lit(at(1000)).cast("timestamp")
    assert [us(r.ts) for r in I.fresh_rows(df, now, F.col("ts"), 180.0).collect()] == [us(at(821))]


def test_outcome_join_matches_the_range_condition(spark, tmp_path):
    f = spark.createDataFrame([(0, at(0), at(300), 5, 0.4, "a")], "station_id long, issued_at timestamp, valid_at timestamp, lead_minutes int, rain_prob double, source_layer string")
    f.write.parquet(str(tmp_path / "f"))
    r = spark.createDataFrame([(0, at(t), 0.0) for t in (209, 210, 390, 391)] + [(1, at(300), 0.0)], "station_id long, ts timestamp, rain_flag double")
    r.write.parquet(str(tmp_path / "r"))
    out = drain(I.outcomes(file_stream(spark, str(tmp_path / "f"), f.schema), file_stream(spark, str(tmp_path / "r"), r.schema)), "outcomes")
    assert sorted(us(x.ts) for x in out.collect()) == [us(at(210)), us(at(390))]


def test_a_stopped_stream_goes_on_with_its_state(spark, tmp_path):
    """The same as one run, though the second half arrives after a stop."""
    df = spark.createDataFrame([(1, *p) for p in _polls(3, 120)], "station_id long, ts timestamp, wet boolean, alert boolean, radar boolean")
    source = in_batches(spark, df, tmp_path, parts=4, last=True)
    whole = drain(ST.alerts(source), "alerts", machine=True).filter(f"station_id <> {LAST}")
    held = [os.path.join(tmp_path, "in", f"{i}.parquet") for i in (2, 3, 4)]
    os.makedirs(tmp_path / "late")
    data = {}
    for f in held:
        with open(f, "rb") as src:
            data[f] = src.read()
        os.replace(f, os.path.join(tmp_path, "late", os.path.basename(f)))
    paths = {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state")}
    first = drain(ST.alerts(source), "alerts", machine=True, **paths).count()
    for i, f in enumerate(held):
        with open(f, "wb") as dst:
            dst.write(data[f])
        os.utime(f, (time.time() + i, time.time() + i))
    both = drain(ST.alerts(source), "alerts", machine=True, **paths).filter(f"station_id <> {LAST}")
    assert 0 < first < both.count() == df.count()
    assert both.exceptAll(whole).count() == 0


def test_revisions_go_on_in_their_folder(spark, tmp_path):
    rows = [(1, at(3600 * k), at(3600 * (k + h)), 20.0 + k, 10.0 * h) for k in range(4) for h in range(6)]
    schema = "station_id long, issued_hour timestamp, valid_at timestamp, temp double, rain_prob double"
    full = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "in")
    full.filter(F.col("issued_hour") < F.lit(at(7200))).write.parquet(path)
    stream = file_stream(spark, path, full.schema)
    assert RV.watch(stream, folder=str(tmp_path / "rev")).count() == 2
    full.filter(F.col("issued_hour") >= F.lit(at(7200))).write.mode("append").parquet(path)
    live = RV.watch(stream, folder=str(tmp_path / "rev"))
    assert live.count() == 4 and live.exceptAll(compare_issues(full).select(live.columns)).count() == 0


def test_late_readings_are_stored_once(spark, tmp_path):
    """Batches far out of order, with repeats across them."""
    rows = [(k % 3, at(977 * (k * 37 % 50)), float(k % 50), 50.0, 1000.0, 0.0) for k in range(100)]
    df = frame(spark, rows)
    for i in range(4):
        df.filter(F.col("temp") % 4 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1)
    paths = (str(tmp_path / "out"), str(tmp_path / "state"))
    assert I.store_unique(stream, *paths).count() == df.select("station_id", "ts").distinct().count()
    df.limit(10).write.mode("append").parquet(str(tmp_path / "in"))
    assert I.store_unique(stream, *paths).count() == df.select("station_id", "ts").distinct().count()


def test_rows_without_station_or_time_are_refused(spark):
    from gaugeflow.operators.chunks import with_chunk

    for row in ((None, at(0)), (1, None)):
        with pytest.raises(Exception, match="station or time"):
            with_chunk(spark.createDataFrame([row], "station_id long, ts timestamp")).collect()


@pytest.mark.parametrize("name", ["stream_alerts", "stream_rain_sessions", "stream_repeats", "stream_outcomes", "stream_revisions"])
def test_staged_tables_in_many_batches_lose_nothing(spark, tmp_path, monkeypatch, name):
    """One file a micro-batch gives the rows of one micro-batch in all."""
    sf, build = "/root/testdata/sf0.01", load_queries()[name].build
    whole = cut(build(spark, sf), "whole")
    monkeypatch.setattr(run, "BATCH_BYTES", 1)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        split = cut(build(spark, sf), "split")
    finally:
        spark.conf.unset(key)
    assert whole.count() > 0 and split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0


def test_dropped_rows_are_an_error(spark, tmp_path):
    """Files that each span the whole time."""
    df = frame(spark, series(3, 400)).select("station_id", "ts", "rain_flag")
    df.repartition(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema, maxFilesPerTrigger=1)
    with pytest.raises(RuntimeError, match="dropped"):
        drain(ST.rain_sessions(stream, delay="0 seconds"), "sessions", machine=True, whole=True)
