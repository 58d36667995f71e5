"""Plan properties that keep hot keys off a single task."""

import datetime as dt

from pyspark.sql import functions as F

from visiflow.operators.asof import asof_join
from visiflow.operators.index import chunked_window, dense_index, time_chunk


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _hot(spark, n=20000):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), "hot", float(i % 97)) for i in range(n)]
    rows += [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), "cold", 1.0) for i in range(50)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, zone string, rvr double")


def test_window_partitions_by_zone_and_chunk(spark):
    df = dense_index(_hot(spark), ["zone"], ["ts"], time_chunk("ts"), "i")
    out = chunked_window(df, ["zone"], "i", {"lag_1": lambda fr: F.first("rvr").over(fr(-1, -1))}, 1, 512)
    plan = _plan(out)
    assert "hashpartitioning(zone" in plan and "_wc" in plan and "_chunk" in plan
    # the hot zone's rows spread over many (zone, chunk) window partitions
    n_chunks = df.select(F.floor(F.col("i") / 512)).distinct().count()
    assert n_chunks >= 30


def test_asof_partitions_by_key_and_bucket(spark):
    left = _hot(spark, 5000)
    right = _hot(spark, 5000).withColumn("ts", F.timestamp_add("MINUTE", F.lit(3), "ts"))
    out = asof_join(left, right, "ts", by=["zone"], tolerance_minutes=30, direction="nearest")
    plan = _plan(out)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "_b" in plan
    assert out.filter(F.col("right_ts").isNull()).count() == 0


def test_scan_logs_only_year_folders(spark, tmpdir_path):
    import os
    from visiflow.sources.readings import scan_logs
    good = os.path.join(tmpdir_path, "2024", "site")
    bad = os.path.join(tmpdir_path, "misc")
    os.makedirs(good)
    os.makedirs(bad)
    with open(os.path.join(good, "a.txt"), "w") as f:
        f.write("17-02-2024\t13:01:05\tRWY 09 (BEG) 1200\n17-02-2024\t13:02:05\tRWY 09 (BEG) 1300\n")
    with open(os.path.join(good, "b.csv"), "w") as f:
        f.write("17-02-2024\t13:01:05\tRWY 09 (BEG) 9999\n")
    with open(os.path.join(bad, "c.txt"), "w") as f:
        f.write("17-02-2024\t13:01:05\tRWY 09 (BEG) 7777\n")
    rows = scan_logs(spark, tmpdir_path).collect()
    assert sorted(r.rvr for r in rows) == [1200.0, 1300.0]
    assert {r.year for r in rows} == {2024}


def test_scoring_sink_replay_is_idempotent(spark, tmpdir_path):
    from visiflow.streaming.jobs import scoring_sink
    rows = [("z", dt.datetime(2024, 1, 1, 0, i), 500.0 + i, 400.0, 300.0, 200.0, True, False) for i in range(5)]
    batch = spark.createDataFrame(rows, "zone string, ts timestamp_ntz, rvr double, lag_1 double, lag_2 double, "
                                        "lag_3 double, ready boolean, late boolean")
    coefs = spark.createDataFrame([("z", 10.0, 0.9)], "zone string, a double, b double")
    handle = scoring_sink(coefs, f"{tmpdir_path}/history", f"{tmpdir_path}/latest")
    handle(batch, 0)
    handle(batch, 0)          # a replay of the same batch id
    handle(batch, 1)          # a later batch with the same readings
    hist = spark.read.parquet(f"{tmpdir_path}/history/data")
    assert hist.filter(F.col("batch_id") == 0).count() == 5
    latest = spark.read.parquet(f"{tmpdir_path}/latest/v=1")
    assert latest.count() == 1 and latest.first().source == "model"


def test_read_weather_runway_from_file_name(spark, tmpdir_path):
    import os
    from visiflow.sources.readings import read_weather
    header = "Date,Time,Temperature1MinAvg (DEG C),Humidity1MinAvg (%Rh)\n"
    for name, t in (("RUNWAY11_2024.csv", "21.5"), ("RUNWAY-28_2024.csv", "19.0")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(header + f"17/02/2024,13:01:05,{t},80\n31/02/2024,13:02:05,{t},80\n")
    w = read_weather(spark, tmpdir_path)
    got = sorted((r.runway, r.temperature, r.humidity) for r in w.collect())
    assert got == [("RUNWAY-28", 19.0, 80.0), ("RUNWAY11", 21.5, 80.0)]    # impossible date dropped
