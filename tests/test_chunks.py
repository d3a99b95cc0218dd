"""Chunked windows must equal their plain, per-station definition at any chunk length."""

import pytest
from helpers import at, frame, series
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeflow.operators import chunks as C
from gaugeflow.operators import segments as S
from gaugeflow.policy import HOUR


@pytest.fixture(scope="module")
def history(spark):
    return frame(spark, series(1, 600) + series(2, 300, station=1)).dropDuplicates(["station_id", "ts"]).cache()


def test_ordinal_and_running_total(history):
    w = Window.partitionBy("station_id").orderBy("ts")
    df = C.ordinal(C.with_chunk(history, HOUR), ["station_id"], ["ts"], "n")
    df = C.running_total(df, ["station_id"], ["ts"], F.col("rain_flag"), "wet")
    want = history.select("station_id", "ts", F.row_number().over(w).alias("n"), F.sum("rain_flag").over(w).cast("long").alias("wet"))
    assert df.select("station_id", "ts", "n", "wet").exceptAll(want).count() == 0


def test_cut_points_find_the_row_at_a_rank(history):
    got = C.cut_points(history, ["station_id"], ["ts"], {"mid": lambda n: F.floor(n / 2)})
    w = Window.partitionBy("station_id").orderBy("ts")
    n = F.count("*").over(Window.partitionBy("station_id"))
    want = history.withColumn("i", F.row_number().over(w) - 1).withColumn("n", n).filter("i = floor(n / 2)")
    assert {(r.station_id, r.mid.ts) for r in got.collect()} == {(r.station_id, r.ts) for r in want.collect()}


@pytest.mark.parametrize("span", [HOUR // 2, 5 * HOUR])
def test_repair_does_not_depend_on_chunk_length(history, span):
    def repaired(length):
        df = C.core_only(S.repaired_chunks(history, span=length))
        return df.select("station_id", "ts", "temp", "rain_flag", S.FILLED, "_start")

    long, short = repaired(1000 * HOUR), repaired(span)
    assert long.exceptAll(short).count() == 0 and short.exceptAll(long).count() == 0


def test_repair_rules(spark):
    rows = [(0, at(t), v, 50.0, 1000.0, r) for t, v, r in [
        (0, 10.0, 0.0), (60, 11.0, 0.0), (63, 12.0, 0.0), (213, 15.0, 1.0), (303, 16.0, 0.0), (933, 26.0, 0.0), (1564, 1.0, 0.0)]]
    got = S.repaired_series(frame(spark, rows)).orderBy("ts").collect()
    filled = [(r.ts, r.temp, r.rain_flag) for r in got if r[S.FILLED] == 1.0]
    # The row at 60 s is the older half of a burst.  63 -> 213 is 150 s: 2.5 slots round to 2, so one row.
    assert filled[0][1:] == (13.5, 1.0)
    # 213 -> 303 is exactly 90 s and stays; 303 -> 933 is 630 s, the longest fillable gap: nine rows.
    assert len(filled) == 1 + 9
    # 933 -> 1564 is 631 s: a new segment.
    assert [r.segment_id for r in got] == [0] * (len(got) - 1) + [1]
    assert [r.temp for r in got][:2] == [10.0, 12.0]


def test_tail_is_bounded(spark):
    now = F.lit(at(1000)).cast("timestamp")

    def tail(last):
        df = S.extend_tail(frame(spark, [(0, at(last), 1.0, 50.0, 1000.0, 0.0)]), now)
        return sorted(int((r.ts.timestamp() - at(0).timestamp())) for r in df.collect() if r[S.TAIL] == 1.0)

    assert tail(820) == []  # exactly 180 s old
    assert tail(760) == [820, 880, 940]  # up to 20 s before now
    assert len(tail(400)) == 9  # exactly 600 s
    assert tail(399) == []


def test_live_gate(spark):
    now = F.lit(at(1000)).cast("timestamp")
    rows = [(0, at(900), 1.0, 50.0, 1000.0, 0.0), (1, at(900), None, 50.0, 1000.0, 0.0), (2, at(300), 1.0, 50.0, 1000.0, 0.0), (3, at(1061), 1.0, 50.0, 1000.0, 0.0)]
    got = {r.station_id: r.status for r in S.live_gate(frame(spark, rows), now, ["temp"]).collect()}
    assert got == {0: "ready", 1: "insufficient_context", 2: "not_current", 3: "not_current"}
