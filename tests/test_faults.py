"""Inputs that the test tables do not hold: nulls, duplicates, odd headers, paths and orders of arrival."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def readings(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m), z, v) for m, z, v in rows], "ts timestamp_ntz, zone string, rvr double")


def test_bins_of_only_nulls_take_no_position(spark):
    from visiflow.operators.binning import bin_mean
    from visiflow.operators.windows import lag_features
    bins = bin_mean(readings(spark, [(0, "a", 500.0), (10, "a", None), (20, "a", 700.0), (0, "b", None)])).select("ts", "zone", "rvr")
    assert bins.select("zone").distinct().count() == 1 and bins.count() == 2
    out = {r.ts: r.lag_1 for r in lag_features(bins, lags=(1,)).collect()}
    assert out == {T0 + dt.timedelta(minutes=20): 500.0}


def test_valid_lags_count_a_time_once(spark):
    from visiflow.operators.windows import valid_lag_features
    rows = valid_lag_features(readings(spark, [(0, "a", 5.0), (1, "a", 7.0), (1, "a", 6.0), (1, "a", 6.0), (2, "a", 8.0), (3, "a", 3333.0)]))
    assert [(r.rvr, r.lag_1, r.ready) for r in rows.orderBy("ts").collect()] == [(5.0, None, False), (6.0, 5.0, False), (8.0, 6.0, False)]


def test_weather_files_are_read_by_their_own_header(spark, tmp_path):
    from visiflow import config as C
    from visiflow.plans.cleaning import clean_weather
    from visiflow.sources.readings import read_weather, skipped_files
    names = dict(zip(C.WEATHER_CANONICAL, C.WEATHER_COLUMNS[2:]))
    base = tmp_path / "weather a"
    base.mkdir()
    (base / "RUNWAY28_2024.csv").write_text(f"Date,Time,{names['temperature']},{names['humidity']}\n01/01/2024,00:00:00,19.5,70\n")
    (base / "RUNWAY29_2024.csv").write_text(f"{names['humidity']},Time,{names['temperature']},Date\n71,00:00:00,20.5,01/01/2024\n")
    (base / "RUNWAY11_2024.csv").write_text(f"When,{names['humidity']}\n2024,5\n")
    rows = {r.runway: (r.temperature, r.humidity) for r in read_weather(spark, str(base)).collect()}
    assert rows == {"RUNWAY28": (19.5, 70.0), "RUNWAY29": (20.5, 71.0)}
    skipped = [r.source_file for r in skipped_files(spark, str(base), ["Date", "Time"]).collect()]
    assert len(skipped) == 1 and "RUNWAY11" in skipped[0]
    wind = tmp_path / "wind"
    wind.mkdir()
    (wind / "RUNWAY28_2024.csv").write_text(f"Date,Time,{names['wind_speed']}\n01/01/2024,00:04:00,8\n")
    both = clean_weather(read_weather(spark, str(base)), read_weather(spark, str(wind)), per_file=True).collect()
    assert [(r.runway, r.temperature, r.wind_speed) for r in both] == [("RUNWAY28", 19.5, 8.0)]
    assert "weather" in both[0].source_file_para and "wind" in both[0].source_file_wind


def test_logs_below_a_path_with_blanks(spark, tmp_path):
    from visiflow.sources.readings import newest_file, scan_logs
    year = tmp_path / "logs a+b%20" / "2024"
    year.mkdir(parents=True)
    (year / "x.txt").write_text("01-01-2024\t00:00:00\tRWY 28 TDZ 550\n")
    rows = scan_logs(spark, str(tmp_path / "logs a+b%20")).collect()
    assert [(r.year, r.rvr) for r in rows] == [(2024, 550.0)]
    (year / "y.txt").write_text("")
    import os
    os.utime(year / "x.txt", (2e9, 2e9))
    assert newest_file(spark, str(tmp_path / "logs a+b%20"), "*.txt").endswith("x.txt")


@pytest.mark.parametrize("scale,small", [(1.0, 100_000), (1e6, 100_000), (1.0, 100)])
def test_quantiles_of_small_wide_and_bracketed_values(spark, monkeypatch, scale, small):
    from visiflow.operators import prep
    monkeypatch.setattr(prep, "SMALL_KEY", small)
    rng = random.Random(1)
    data = {"a": [rng.random() * scale for _ in range(3000)], "b": [float(int(rng.random() * 5)) for _ in range(2000)] + [2.0] * 3000, "c": [1.5]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("d", None)], "zone string, v double").repartition(4)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    rows = {r.zone: r for r in prep.exact_quantiles(df, "v", qs, ["zone"]).collect()}
    assert set(rows) == set(data)
    for k, vs in data.items():
        got = [rows[k][f"q_{int(q * 100)}"] for q in qs]
        assert np.allclose(got, np.quantile(vs, qs), rtol=1e-12)
    kept = prep.drop_outliers(spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 1000]] + [("a", None)], "zone string, v double"), "v")
    assert sorted((r.v is None, r.v or 0) for r in kept.collect()) == [(False, 1.0), (False, 2.0), (False, 3.0), (False, 4.0), (True, 0)]


def test_backfill_does_not_look_ahead(spark):
    from visiflow.plans.scoring import range_backfill
    rng = random.Random(3)
    rows = [(10 * k, "a", 500 + 100 * rng.random()) for k in range(60)]
    later = [(m, z, v if m < 400 else v * 3) for m, z, v in rows]
    lo, hi = (F.lit(T0 + dt.timedelta(minutes=m)).cast("timestamp_ntz") for m in (300, 390))
    a, b = ({r.ts: (r.value, r.source) for r in range_backfill(readings(spark, x), lo, hi).collect()} for x in (rows, later))
    assert a == b and {s for _, s in a.values()} == {"model"} and len(a) == 10


def test_grid_forecast_does_not_read_its_own_placeholder(spark):
    from visiflow.plans.features import FeatureSpec, build_features
    from visiflow.plans.scoring import model_forecast
    bins = readings(spark, [(10 * k, z, 100.0 * k + n) for k in range(5) for n, z in enumerate("abc")])
    spec = FeatureSpec(kind="grid", n_other=2, lags=(1,), windows=())
    hold = readings(spark, [(50, z, None) for z in "abc"])
    rows = {r.zone: (r.lag_1, r.other_1, r.other_2) for r in build_features(bins.unionByName(hold), spec).filter("y is null").collect()}
    assert rows == {"a": (400.0, 401.0, 402.0), "b": (401.0, 400.0, 402.0), "c": (402.0, 400.0, 401.0)}
    with pytest.raises(ValueError):
        model_forecast(bins, {}, FeatureSpec(kind="grid", cross_zone_lag=0), 1)


def test_forecast_starts_at_one_time(spark):
    from visiflow.plans.scoring import linear_ar_forecast
    bins = readings(spark, [(0, "a", 100.0), (50, "b", 200.0)])
    coefs = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 1.0)], "zone string, a double, b double")
    rows = linear_ar_forecast(bins, coefs, 1, 15).collect()
    assert {r.ts for r in rows if r.step == 0} == {T0 + dt.timedelta(minutes=50)}
    assert {r.zone: r.forecast for r in rows if r.step == 2} == {"a": 100.0, "b": 203.0}


def test_live_state_in_pieces_equals_one_batch():
    import pandas as pd
    from visiflow.streaming.state import live_state

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng = random.Random(2)
    df = pd.DataFrame({"ts": [T0 + dt.timedelta(minutes=k) for k in range(40)], "rvr": [rng.choice([None, 3333.0, 10.0 * k + 1]) for k in range(40)]})
    whole = next(live_state(("a",), iter([df]), State()))
    state, parts = State(), []
    for a, b in ((0, 7), (7, 8), (8, 25), (20, 40)):       # the last two overlap: seen again, not entered twice
        parts += list(live_state(("a",), iter([df[a:b]]), state))
    parts = pd.concat(parts)
    parts = parts[~parts.late].reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts, check_dtype=False)
