"""Hand-computed micro-fixtures (FIXTURES.md §3)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from visiflow.functions.geo import destination
from visiflow.functions.names import safe_zone, zone_from_safe
from visiflow.functions.times import calendar_columns, time_grid
from visiflow.functions.values import current_value, is_valid, status_band, to_value
from visiflow.operators.asof import asof_join
from visiflow.operators.binning import bin_mean
from visiflow.operators.index import with_positions
from visiflow.operators.windows import cv_folds, grid_features, temporal_split, valid_lag_features
from visiflow.operators.state import readiness
from visiflow.plans.scoring import fallback_chain
from visiflow.sources.readings import parse_log_lines

T = dt.datetime


def test_log_parse(spark):
    lines = [
        "17-02-2024\t13:01:05\tRWY 09 (BEG) 1200\tRunway 28 (TDZ) 800",
        "17-02-2024\t13:08:05\tRWY 09 (BEG) 1000\tRWY 28 (TDZ) -\t",
        "17-02-2024\t13:10:00\tRWY 09 (BEG) 3333\tRWY 28 (TDZ) 12.5",
        "31-02-2024\t13:11:00\tRWY 09 (BEG) 500",
        "2024-02-17\t13:12:00\tRWY 09 (BEG) 500",
        "garbage",
        "17-02-2024\t13:19:59\tRWY09\tRW28-L 600",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    bins = bin_mean(parse_log_lines(df)).filter(F.col("rvr").isNotNull())
    got = {(r.ts, r.zone): r.rvr for r in bins.collect()}
    assert got == {
        (T(2024, 2, 17, 13, 0), "RWY 09 (BEG)"): 1100.0,
        (T(2024, 2, 17, 13, 0), "RWY 28 (TDZ)"): 800.0,
        (T(2024, 2, 17, 13, 10), "RWY 09 (BEG)"): 3333.0,
        (T(2024, 2, 17, 13, 10), "RW28-L"): 600.0,
    }


def _series(spark, values):
    rows = [(T(2024, 1, 1) + dt.timedelta(minutes=10 * i), "z", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, zone string, rvr double")


def test_windows_fixture(spark):
    df = _series(spark, [100.0, 200.0, None, 400.0, 500.0, 600.0, 700.0])
    cells = with_positions(df)
    f = grid_features(cells, lags=(1,), strict_windows=(3,), lenient_windows=(3,)).orderBy("pos").collect()
    assert [r.lag_1 for r in f] == [None, 100, 200, None, 400, 500, 600]
    assert [r.roll_mean_3 for r in f] == [None, None, None, None, None, 500, 600]
    assert [r.roll_mean_3_lenient for r in f] == [100, 150, 150, 300, 450, 500, 600]
    prev = grid_features(cells, lags=(), strict_windows=(3,), include_current=False).orderBy("pos").collect()
    assert [r.roll_mean_3 for r in prev] == [None] * 6 + [500]


def test_chunked_equals_unchunked(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        F.col("ts"), F.col("event_type").alias("zone"), (F.col("value") * 10).alias("rvr"))
    cells = with_positions(bin_mean(df).select("ts", "zone", "rvr"))
    a = grid_features(cells, chunk_positions=4096)
    b = grid_features(cells, chunk_positions=20)      # many chunks, halo of 11 positions
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_asof_fixture(spark):
    left = spark.createDataFrame([(T(2024, 1, 1, h, 0),) for h in (10, 11, 13)], "ts timestamp_ntz")
    right = spark.createDataFrame([(T(2024, 1, 1, 9, 40), 1), (T(2024, 1, 1, 10, 20), 2),
                                   (T(2024, 1, 1, 11, 30), 3), (T(2024, 1, 1, 13, 31), 4)],
                                  "ts timestamp_ntz, v int")
    got = {r.ts.hour: r.right_v for r in asof_join(left, right, "ts", tolerance_minutes=30).collect()}
    assert got == {10: 1, 11: 3, 13: None}


def test_asof_tolerance_zero_is_equijoin(spark):
    left = spark.createDataFrame([(T(2024, 1, 1, 0, m),) for m in range(0, 60, 7)], "ts timestamp_ntz")
    right = spark.createDataFrame([(T(2024, 1, 1, 0, m), m) for m in range(0, 60, 3)], "ts timestamp_ntz, v int")
    a = asof_join(left, right, "ts", tolerance_minutes=0).filter(F.col("right_v").isNotNull()).count()
    b = left.join(right, "ts").count()
    assert a == b


def test_status_and_validity(spark):
    vals = [800.0, 799.9, 500.0, 499.9, 200.0, 199.9]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r.s for r in df.select(status_band("v").alias("s")).collect()] == \
        ["Good", "Moderate", "Moderate", "Poor", "Poor", "Very Poor"]
    raw = spark.createDataFrame([(x,) for x in [None, "", "-", "0", "0.1", "3332.9", "3333", "4000"]], "x string")
    got = [r.ok for r in raw.select(is_valid(to_value("x")).alias("ok")).collect()]
    assert got == [False, False, False, False, True, True, False, False]
    cur = spark.createDataFrame([(None,), (3333.0,), (0.0,), (4000.0,)], "v double")
    assert [r.c for r in cur.select(current_value("v").alias("c")).collect()] == [1000.0, 1000.0, 0.0, 4000.0]


def test_readiness_and_live_lags(spark):
    rows = []
    for zone, n in (("a", 3), ("b", 4), ("c", 9)):
        rows += [(T(2024, 1, 1, 0, i), zone, 850.0 + 50 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, zone string, rvr double")
    got = {r.zone: (r.data_points, r.can_predict) for r in readiness(df).collect()}
    assert got == {"a": (3, False), "b": (4, True), "c": (4, True)}
    lags = valid_lag_features(df.filter(F.col("zone") == "b")).orderBy("ts").collect()[-1]
    assert (lags.lag_1, lags.lag_2, lags.lag_3, lags.ready) == (950.0, 900.0, 850.0, True)


def test_split_and_folds(spark):
    df = spark.createDataFrame([(T(2024, 1, 1, 0, i), "z") for i in range(7)], "ts timestamp_ntz, zone string")
    s = temporal_split(df).orderBy("ts").collect()
    assert [r.split for r in s] == ["train"] * 5 + ["test"] * 2
    f = cv_folds(df).orderBy("ts").collect()
    assert [r.fold for r in f] == [0, 0, 0, 1, 1, 2, 2]


def test_fallback(spark):
    df = spark.createDataFrame([(None, 640.0), (None, None), (710.0, 640.0)], "predicted double, current double")
    got = [(r.value, r.source) for r in fallback_chain(df).collect()]
    assert got == [(640.0, "current"), (1000.0, "default"), (710.0, "model")]


def test_calendar_names_grid_geo(spark):
    df = spark.createDataFrame([(T(2024, 1, 1, 0, 0),)], "ts timestamp_ntz")
    assert df.select(calendar_columns("ts")["day_of_week"].alias("d")).first().d == 0
    z = spark.createDataFrame([("RWY 09 (BEG)",)], "z string").select(safe_zone("z").alias("s"))
    assert z.first().s == "RWY_09_BEG"
    assert z.select(zone_from_safe("s").alias("n")).first().n == "RWY 09 (BEG)"
    g = df.select(time_grid("ts", 24, 15).alias("g")).first().g
    assert len(g) == 97 and g[0] == T(2024, 1, 1, 0, 0)
    lat, lon = destination(F.lit(28.546269726812046), F.lit(77.07209263473048), F.lit(103.0), F.lit(300.0))
    p = df.select(lat.alias("lat"), lon.alias("lon")).first()
    assert math.isclose(p.lat, 28.54566, abs_tol=1e-5) and math.isclose(p.lon, 77.07508, abs_tol=1e-5)
