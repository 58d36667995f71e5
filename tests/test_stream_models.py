"""Stream = batch, model properties and sinks."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import MEDIUM, SMALL


def test_stream_state_equals_batch(spark):
    qs = E.queries()
    s = qs["stream_valid_lags"](spark, SMALL)
    b = qs["valid_lag_features"](spark, SMALL)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_bins_close_all_but_open_bins(spark):
    qs = E.queries()
    s = qs["stream_bins"](spark, SMALL)
    b = qs["bin_mean_10min"](spark, SMALL)
    missing = b.select("ts", "zone").exceptAll(s.select("ts", "zone")).count()
    assert s.select("ts", "zone").exceptAll(b.select("ts", "zone")).count() == 0
    assert missing <= 5          # only bins still open at the final watermark


def test_model_determinism_and_save_load(spark, tmpdir_path):
    from visiflow.plans import q_models
    from visiflow.plans.features import FeatureSpec
    from visiflow.plans.training import fit_fixed, load_model, usable_features
    spec = FeatureSpec(kind="valid", n_other=0)
    table, zones, spec = q_models._setup(spark, SMALL, spec)
    z = zones[0]
    feats = usable_features(table, spec)[z]
    r1 = fit_fixed(table, z, feats, 5, 1)
    r2 = fit_fixed(table, z, feats, 5, 1)
    assert abs(r1.metrics["test_rmse"] - r2.metrics["test_rmse"]) < 1e-9
    path = os.path.join(tmpdir_path, "m")
    r1.model.write().overwrite().save(path)
    m = load_model(path)
    rows = table.filter(F.col("zone") == z).dropna(subset=feats)
    a = r1.model.transform(rows).select("ts", "pred")
    b = m.transform(rows).select("ts", "pred")
    assert a.exceptAll(b).count() == 0


def test_linear_nowcast_beats_mean_on_ar_series(spark):
    import numpy as np
    import datetime as dt
    from visiflow.operators.metrics import regression_metrics
    from visiflow.operators.windows import valid_lag_features
    from visiflow.plans.scoring import fit_linear_nowcast, linear_nowcast
    rng = np.random.default_rng(0)
    x = [800.0]
    for _ in range(999):
        x.append(200 + 0.8 * x[-1] + rng.normal(0, 30))
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), "z", float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, zone string, rvr double")
    st = valid_lag_features(df)
    p = linear_nowcast(st, fit_linear_nowcast(st)).filter(F.col("predicted").isNotNull())
    m = regression_metrics(p.withColumn("g", F.lit(1)), ["g"], "rvr", "predicted").first()
    assert m.r2 > 0.5


def test_sinks_and_newest_file(spark, tmpdir_path):
    import time
    from visiflow.sources.readings import newest_file_rows, time_column
    from visiflow.sources.sinks import append_history, write_latest
    df = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", F.col("event_type").alias("zone"), "value")
    append_history(df, f"{tmpdir_path}/hist")
    write_latest(df, f"{tmpdir_path}/latest")
    latest = spark.read.parquet(f"{tmpdir_path}/latest")
    assert latest.count() == df.select("zone").distinct().count()
    assert time_column(df.withColumnRenamed("ts", "Datetime")) == "Datetime"
    assert time_column(df) is None
    df.limit(3).write.parquet(f"{tmpdir_path}/feeds/a")
    time.sleep(1.1)
    df.limit(5).write.mode("append").parquet(f"{tmpdir_path}/feeds/a")
    rows = newest_file_rows(spark.read.parquet(f"{tmpdir_path}/feeds/a"))
    assert rows.count() == 5


def test_medium_band_counts_total(spark):
    out = E.queries()["status_band_counts"](spark, MEDIUM)
    assert out.agg(F.sum("n_bins")).first()[0] == 8016


def test_start_from_and_write_range(spark, tmpdir_path):
    from visiflow.plans.cleaning import start_from
    from visiflow.sources.sinks import write_range
    df = spark.createDataFrame([(r,) for r in ["RUNWAY09", "RUNWAY10", "RUNWAY11", "RUNWAY28"]], "runway string")
    assert [r.runway for r in start_from(df, "runway", "RUNWAY11").orderBy("runway").collect()] == \
        ["RUNWAY11", "RUNWAY28"]
    assert start_from(df, "runway", "RUNWAY12").count() == 0
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", "value")
    write_range(ev, f"{tmpdir_path}/range")
    back = spark.read.option("header", "true").csv(f"{tmpdir_path}/range")
    assert back.count() == ev.count()
    assert back.filter(~F.col("ts").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$")).count() == 0


def test_year_partition_pruning(spark, tmpdir_path):
    import datetime as dt
    from visiflow.sources.readings import select_year
    from visiflow.sources.sinks import write_yearly
    rows = [(dt.datetime(y, 1, 1, 0, 0), "z", float(y)) for y in (2023, 2024) for _ in range(3)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, zone string, rvr double")
    write_yearly(df, f"{tmpdir_path}/yearly")
    back = select_year(spark.read.parquet(f"{tmpdir_path}/yearly"), 2024)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert back.count() == 3


def test_model_forecast_steps(spark):
    from visiflow.operators.binning import bin_mean
    from visiflow.plans import q_models
    from visiflow.plans.features import FeatureSpec
    from visiflow.plans.scoring import model_forecast
    from visiflow.plans.training import fit_fixed, usable_features
    from visiflow.sources.readings import readings_from_events
    spec = FeatureSpec(kind="valid", n_other=0)
    table, zones, spec = q_models._setup(spark, SMALL, spec)
    feats = usable_features(table, spec)
    models = {z: fit_fixed(table, z, feats[z], 3, 1).model for z in zones[:2]}
    assert all(feats[z] == spec.columns() for z in models)
    bins = bin_mean(readings_from_events(spark, SMALL)).select("ts", "zone", "rvr")
    out = model_forecast(bins.filter(F.col("zone").isin(list(models))), models, spec, steps=2)
    rows = out.collect()
    assert len(rows) == 2 * len(models)
    assert all(r.rvr is not None for r in rows)


def test_tuned_model_runs_all_fixed_runs_and_the_whole_search(spark, monkeypatch):
    from visiflow import config as C
    from visiflow.plans import q_models
    seen = {}

    def train_all(spark, table, zones, spec, **given):
        seen.update(given)
        return spark.createDataFrame([("z", 1)], "zone string, features int"), {}

    monkeypatch.setattr(q_models, "_setup", lambda spark, sf_dir: (None, [], None))
    monkeypatch.setattr(q_models, "train_all", train_all)
    monkeypatch.setattr(q_models, "best_runs", lambda log: log)
    q_models.tuned_model(spark, "")
    assert list(seen["tree_counts"]) == [10, 25, 20] and seen["grid"] == C.PARAM_GRID and seen["draws"] == 50 and seen["tune"]
