import pytest
from helpers import at, us
from pyspark.sql import functions as F

from gaugeflow.functions import physics as P
from gaugeflow.functions import units as U
from gaugeflow.operators import areas as W
from gaugeflow.operators import clean as C
from gaugeflow.operators import radar as R
from gaugeflow.policy import GridPolicy
from gaugeflow.sources import forecasts as SF
from gaugeflow.sources import history as SH


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_units(spark):
    def lit(x):
        return F.lit(x).cast("string")

    assert one(spark, U.celsius(lit("176"), lit("°F"))) == 80.0
    assert one(spark, U.celsius(lit("81"), lit("C"))) is None
    assert one(spark, U.celsius(lit("20"), lit(None))) == 20.0
    assert one(spark, U.hectopascal(lit("29.92"), lit("inHg"))) == pytest.approx(1013.2075, abs=1e-3)
    assert one(spark, U.humidity_percent(lit("1.5"), lit("ratio"))) == 1.5
    assert one(spark, U.metres_per_second(lit("36"), lit("KM/H"))) == 10.0
    assert one(spark, U.wind_degrees(lit("361"))) is None and one(spark, U.wind_degrees(lit(" sw "))) == 225.0
    assert one(spark, U.rain_wet(lit("0.1"))) is False and one(spark, U.rain_wet(lit("Raining"))) is True
    assert one(spark, U.light_text(lit("none"))) is None
    assert one(spark, U.number(lit("inf"))) is None
    assert one(spark, U.utc_timestamp(lit("2024-01-01T07:00:00+07:00"))).hour == 0


def test_heat_index_and_comfort(spark):
    assert one(spark, P.heat_index(F.lit(26.9), F.lit(90.0))) == 26.9
    assert one(spark, P.heat_index(F.lit(32.0), F.lit(70.0))) == pytest.approx(40.4, abs=0.5)
    assert one(spark, P.comfort_class(F.lit(41.0))) == "danger"


def test_polygons(spark):
    ring = W.parse_polygon(F.lit("0,0 0,4 x 4,4 4,0"))

    def inside(lat, lon, r=ring):
        from gaugeflow.functions.geo import inside_polygon
        return one(spark, inside_polygon(F.lit(float(lat)), F.lit(float(lon)), r))

    assert inside(2, 2) and not inside(5, 2) and not inside(2, 5)
    assert not inside(0, 0, W.parse_polygon(F.lit("0,0 1,1")))


def test_warning_order_and_fallbacks(spark):
    st = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 50.0)], "station_id long, lat double, lon double")
    rows = [("a", 0, 0, "Far place", "10,10 10,12 12,12"), ("a", 1, 0, "north bangkok area", None), ("b", 0, 0, "x", "0,0 0,3 3,3 3,0"), ("c", 0, None, None, None), ("d", 0, 0, "y", None)]
    areas = spark.createDataFrame(rows, "warning_id string, info_index int, area_index int, area_desc string, poly string")
    areas = areas.withColumn("ring", W.parse_polygon(F.coalesce("poly", F.lit(""))))
    got = {(r.station_id, r.warning_id): r.area_match for r in W.match_areas(st, areas, ("Bangkok",)).collect()}
    assert got == {(None, "a"): "configured_area_hint", (1, "b"): "polygon", (None, "c"): "no_area"}
    facts = spark.createDataFrame([("a", "Minor", None), ("b", "Minor", at(5)), ("c", "Severe", None), ("d", "Extreme", None)], "warning_id string, severity string, expires timestamp")
    top = W.shown_at(st, W.match_areas(st, areas, ("Bangkok",)), facts, 2).orderBy("station_id", "position").collect()
    assert [(r.station_id, r.warning_id) for r in top] == [(1, "c"), (1, "b"), (2, "c"), (2, "a")]
    now = F.lit(at(100)).cast("timestamp")
    t = spark.createDataFrame([("Cancel", at(0), at(500)), ("Alert", at(0), at(100)), ("Alert", at(101), None), ("Alert", None, None)], "m string, e timestamp, x timestamp")
    assert [r.s for r in t.select(W.lifecycle(F.col("m"), F.lit("Actual"), F.col("e"), F.col("x"), now).alias("s")).collect()] == ["cancelled", "expired", "scheduled", "active"]


def test_motion_of_a_block_and_ties(spark):
    grid = GridPolicy(window=100, max_shift=6)
    block = [(x, y) for x in range(10, 14) for y in range(20, 23)]
    rows = [(0, x, y, 1) for x, y in block] + [(600, x + 4, y - 2, 1) for x, y in block] + [(1800, 90, 90, 1)]
    px = spark.createDataFrame(rows, "frame_time int, x int, y int, bucket int")
    frames = spark.createDataFrame([(0,), (600,), (1200,), (1800,)], "frame_time int")
    got = R.motion(px, [], frames, grid).collect()
    assert [(r.frame_time, r.dx, r.dy, r.overlap) for r in got] == [(0, 4, -2, 12)]  # pairs with the dry frame are skipped
    far = R.motion(px.filter("frame_time in (600, 1800)"), [], frames.filter("frame_time in (600, 1800)"), grid).first()
    assert (far.dx, far.dy, far.overlap) == (0, 0, 0)


def test_csv_history_of_two_formats(spark, tmp_path):
    (tmp_path / "history_1.csv").write_text("timestamp,temp,humidity,pressure,rain,rain_flag\n2024-01-01 00:00:00,20,50,1000,False,0\n"
                                            "timestamp,temp,humidity,pressure,rain,rain_flag\nnonsense,1,1,1,True,1\n2024-01-01 00:01:00,inf,50,1000,False,0\n")
    (tmp_path / "history_2.csv").write_text("timestamp,temp,humidity,pressure,rain,rain_flag,light\n2024-01-01T07:00:00+07:00,21,50,1000,False,0,900\n2024-01-02T00:00:00Z,22,50,1000,True,1,\n")
    got = SH.scan_csv(spark, [str(tmp_path / "history_1.csv"), str(tmp_path / "history_2.csv")]).orderBy("timestamp").collect()
    assert [(r.temp, r.light, r.wind_speed) for r in got] == [(21.0, 900.0, None), (22.0, None, None)]  # the later file wins


def test_sinks_keep_dates_apart(spark, tmp_path):
    df = spark.createDataFrame([(0, at(0), 1.0), (0, at(86400), 2.0)], "station_id long, ts timestamp, temp double")
    path = str(tmp_path / "readings")
    SH.append_by_date(df, path)
    SH.append_by_date(df.limit(1), path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and "PartitionFilters: [isnotnull(date" in back.filter("date = '2024-03-01'")._jdf.queryExecution().toString()
    assert SH.newest_days(back, 1).count() == 1
    scores = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "as_of_date string, n int")
    out = str(tmp_path / "scores")
    SH.replace_scores(scores, out)
    SH.replace_scores(scores.filter("n = 2").withColumn("n", F.lit(9)), out)
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 9]


def test_insert_ignore_keeps_first_and_merge_keeps_last(spark):
    cols = "station_id long, ts timestamp, v int, seen int"
    old = spark.createDataFrame([(0, at(0), 1, 0)], cols)
    new = spark.createDataFrame([(0, at(0), 2, 1), (0, at(60), 3, 2), (0, at(60), 4, 3)], cols)
    assert [r.v for r in C.insert_ignore(old, new, ["station_id", "ts"], "seen").collect()] == [3]
    assert sorted(r.v for r in C.merge_history(old, new, order="seen").collect()) == [2, 4]
    assert sorted(r.v for r in C.upsert(old, new, ["station_id", "ts"], "seen").collect()) == [2, 4]


def test_hourly_timeline_starts_at_the_current_hour(spark):
    doc = '{"current":{"time":"2024-01-01T01:45"},"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00","2024-01-01T02:00"],"temperature_2m":[1.0,2.0],"weathercode":[0,42,3],"wind_speed_10m":[3.6,7.2,36.0]}}'
    df = spark.createDataFrame([(0, doc)], "station_id long, document string")
    rows = SF.hourly_timeline(df, ["station_id"]).orderBy("lead_hours").collect()
    assert [(r.lead_hours, r.temp, r.condition, r.rain_prob) for r in rows] == [(0, 2.0, "code 42", None), (1, None, "มีเมฆมาก", None)]
    log = SF.nwp_log_rows(SF.hourly_timeline(df, ["station_id"])).collect()
    assert [(r.lead_hours, r.wind_speed) for r in log] == [(0, 2.0)] and us(log[0].issued_hour) == us(log[0].valid_at)
