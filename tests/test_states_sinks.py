"""States of days, folders of mixed files, balanced sinks, canonical snapshots, tables kept by key, cohort metrics."""

import gzip
import time

import pytest
from helpers import at, frame, series
from pyspark.sql import functions as F

from gaugeflow.operators import daily as DS
from gaugeflow.operators import metrics as M
from gaugeflow.operators import revision as V
from gaugeflow.operators import summaries as S
from gaugeflow.sources import history as SH
from gaugeflow.streaming import storage as SG
from gaugeflow.streaming.run import file_stream


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_days_added_one_by_one_equal_the_whole(spark, tmp_path):
    """Each day alone, one of them twice, one corrected; null values have no part in means."""
    rows = series(1, 500, steps=(600, 900)) + [(0, at(5 * 86_400 + 7), None, None, 1000.0, 1.0)]
    df = frame(spark, rows).cache()
    folder, dates = str(tmp_path / "states"), sorted({r[1].date() for r in rows})
    state = lambda part, by: S.summary_state(part, [*by, "station_id"])
    wrong = df.filter(F.to_date("ts") == F.lit(dates[2])).withColumn("temp", F.lit(99.0))
    for part in [wrong, *[df.filter(F.to_date("ts") == F.lit(d)) for d in [dates[0], *dates]]]:
        DS.add_days(part, folder, DS.day_of("ts"), state)
    rounded = lambda t: t.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])
    assert same(rounded(S.summary_of_states(DS.states(spark, folder), ["station_id"])), rounded(S.period_summary(df, ["station_id"])))
    first, before = str(dates[1]), str(dates[4])
    some = S.summary_of_states(DS.states(spark, folder, first, before), ["station_id"])
    assert same(rounded(some), rounded(S.period_summary(df.filter(F.to_date("ts").between(F.lit(dates[1]), F.lit(dates[3]))), ["station_id"])))
    plan = DS.states(spark, folder, first, before)._jdf.queryExecution().executedPlan().toString()
    assert f"{DS.DATE}#" in plan.split("PartitionFilters")[1].split("]")[0]  # other days are not read


def test_a_folder_of_mixed_files(spark, tmp_path):
    """Headers in other orders, quoted, with a byte-order mark, compressed, repeated; an empty file; one named only in a subfolder."""
    files = {
        "a.csv": "timestamp,temp,humidity,pressure,rain_flag\n2024-01-01 00:00:00,1,50,1000,0\n2024-01-01 00:01:00,2,50,1000,0\n",
        "b.csv": "﻿rain_flag,\"timestamp\",light,temp,humidity,pressure\n1,2024-01-01T00:02:00Z,700,3,50,1000\nrain_flag,timestamp,light,temp,humidity,pressure\n",
        "c.csv": "timestamp,temp,humidity,pressure,rain_flag\n2024-01-01 00:01:00,9,50,1000,0\n",
        "d.csv": "",
        "sub/e.csv": "timestamp,temp,humidity,pressure,rain_flag,light\n2024-01-01 00:04:00,5,50,1000,0,\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(b"temp,timestamp,humidity,pressure,rain_flag\n6,2024-01-01 00:05:00,50,1000,0\n"))
    groups = SH.header_groups(spark, str(tmp_path))
    assert sorted(map(len, groups.values())) == [1, 1, 1, 2] and all("temp" in h for h in groups)
    got = sorted((r.timestamp.minute, r.temp, r.light) for r in SH.scan_folder(spark, str(tmp_path)).collect())
    assert got == [(0, 1.0, None), (1, 9.0, None), (2, 3.0, 700.0), (4, 5.0, None), (5, 6.0, None)]
    with pytest.raises(FileNotFoundError):
        SH.scan_folder(spark, str(tmp_path / "sub"), "*.txt")


def test_files_follow_the_bytes_of_a_date(spark, tmp_path):
    """A hot date is split over files, small ones are a file each, and replacing a date leaves the others."""
    hot = spark.range(0, 120_000, numPartitions=6).select(F.lit(1).alias("station_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 700_000).alias("ts"), F.rand(1).alias("temp"))
    small = spark.range(0, 40).select(F.lit(2).alias("station_id"), F.timestamp_micros(F.lit(1_704_240_000_000_000) + F.col("id") * 86_400_000_000).alias("ts"), F.rand(2).alias("temp"))
    path, key = str(tmp_path / "out"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "400k")
    try:
        SH.append_by_date(hot.unionByName(small), path)
    finally:
        spark.conf.set(key, before)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").glob("date=*")}
    assert files["date=2024-01-01"] > 2 and all(n == 1 for d, n in files.items() if d > "date=2024-01-03") and len(files) == 41
    SH.replace_dates(small.limit(1).withColumn("temp", F.lit(-1.0)), path)
    after = spark.read.parquet(path)
    assert after.count() == 120_040 and after.filter("temp = -1.0").count() == 1


def test_canonical_text(spark):
    one = spark.sql("""select named_struct('b', 1, 'a', array(named_struct('y', 2.5D, 'x', 'say "1.5"')), 'c', cast(null as int), 'm', map('k2', 1, 'k1', 1e-9D)) as v""")
    other = spark.sql("""select named_struct('m', map('k1', -0.0D, 'k2', 1.0D), 'a', array(named_struct('x', 'say "1.5"', 'y', 2.5000000001D)), 'c', cast(null as string), 'b', 1.0D) as v""")
    texts = [df.select(V.canonical(F.col("v"))).first()[0] for df in (one, other)]
    assert texts[0] == texts[1] == '{"a":[{"x":"say \\"1.5\\"","y":2.500000}],"b":1.000000,"c":null,"m":{"k1":0.000000,"k2":1.000000}}'
    assert one.select(V.canonical(F.parse_json(F.to_json("v")))).first()[0].startswith('{"a":[{"x"')
    for changed in ("named_struct('a', array(2, 1))", "named_struct('a', array(1, 2, null))", "named_struct('a', '1', 'b', 2)"):
        base = spark.sql("select named_struct('a', array(1, 2)) as v")
        assert spark.sql(f"select {changed} as v").select(V.canonical(F.col("v"))).first()[0] != base.select(V.canonical(F.col("v"))).first()[0]


def test_snapshots_ignore_what_does_not_count(spark):
    text = "'nwp', named_struct('status', 'ready', 'fetched_at_utc', 'T', 'age_seconds', {age})"
    make = lambda age, temp, extra="": spark.sql(
        f"select 'ready' as status, array(named_struct('time', 't1', 'temp', {temp}), named_struct('time', '', 'temp', 7.0D){extra}) as hourly, map({text.format(age=age)}) as source_status")
    ids = [V.with_snapshot_id(make(*a)).first().snapshot_id for a in ((1, "2.0D"), (99, "2.0D"), (1, "2.1D"))]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 20


def test_older_writers_and_replays_change_nothing(spark, tmp_path):
    rows = [(k % 7, (k * 31) % 100, f"s{(k * 31) % 100}") for k in range(100)]
    kind = "id int, version int, state string"
    for i in range(4):
        spark.createDataFrame(rows[25 * i : 25 * i + 25], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    paths = (str(tmp_path / "table"), str(tmp_path / "progress"))
    stream = file_stream(spark, str(tmp_path / "in"), kind, maxFilesPerTrigger=1)
    want = {i: max((v, s) for k, v, s in rows if k == i) for i in range(7)}
    read = lambda: {r.id: (r.version, r.state) for r in SG.Table(spark, paths[0], kind).read().collect()}
    assert {r.id: (r.version, r.state) for r in SG.keep_latest(stream, ["id"], "version", *paths, buckets=3).collect()} == want == read()
    spark.createDataFrame([(1, -5, "stale"), (50, 1, "new")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    SG.keep_latest(stream, ["id"], "version", *paths, buckets=3)
    assert read() == want | {50: (1, "new")}
    kept = [list(p.glob("as_of_batch=*")) for p in (tmp_path / "table" / "rows").glob("in_bucket=*")]
    assert kept and max(map(len, kept)) <= 2
    # A micro-batch whose manifest was not written is as if it had not been.
    table = SG.Table(spark, paths[0], kind)
    table.write(spark.createDataFrame([(1, 999, "torn", 0)], kind + ", in_bucket int"), [0], 50)
    (tmp_path / "table" / "manifests" / "batch=50" / "_SUCCESS").unlink()
    assert read() == want | {50: (1, "new")}


def test_metrics_per_cohort(spark):
    rows = [(0, at(60 * k), "test" if k >= 300 else "train", float(k % 9 == 0), float(k % 5 == 0), 0.2 * (k % 4 == 0), 0.1 + 0.5 * (k % 9 == 0) + (k % 4) / 20) for k in range(600)]
    df = spark.createDataFrame(rows, "station_id long, ts timestamp, part string, observed double, rain_flag double, rain_last_60m double, probability double")
    got = {r.cohort: r for r in M.holdout_metrics(df, 0.5).collect()}
    test = [r for r in rows if r[2] == "test"]
    cohorts = {"all": test, "dry_now": [r for r in test if r[4] == 0], "dry_60m": [r for r in test if r[4] == 0 and r[5] == 0]}
    assert got.keys() == cohorts.keys()
    for name, part in cohorts.items():
        r = got[name]
        assert r.n == len(part) and r.brier == pytest.approx(sum((x[6] - x[3]) ** 2 for x in part) / len(part))
        assert r.persistence_brier == pytest.approx(sum((x[4] - x[3]) ** 2 for x in part) / len(part))
        assert r.tp == sum(x[6] >= 0.5 and x[3] == 1 for x in part) and 0 < r.average_precision <= 1
    assert "dry_60m" not in {r.cohort for r in M.holdout_metrics(df.drop("rain_last_60m"), 0.5).collect()}


def test_comparison_refuses_repeated_rows(spark):
    one = spark.createDataFrame([(0, 1, 0.3, 0.0), (0, 2, 0.6, 1.0)], "station_id long, t int, probability double, observed double")
    assert M.compare_on_common(one, one, ["station_id", "t"]).first().n == 2
    for a, b in ((one.unionByName(one.limit(1)), one), (one, one.unionByName(one.limit(1)))):
        with pytest.raises(Exception, match="more than once"):
            M.compare_on_common(a, b, ["station_id", "t"]).collect()


def test_no_feature_input_is_constant(spark):
    from gaugeflow.plans import load_queries

    df = load_queries()["feat_external"].build(spark, "/root/testdata/sf0.01")
    names = [c for c in df.columns if c not in ("station_id", "ts_us")]
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in names]).first().asDict()
    assert len(names) > 30 and min(counts.values()) > 1, {c: n for c, n in counts.items() if n < 2}
