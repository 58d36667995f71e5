"""The staged search against plain cross-validation, the pooled model, the trees' forecast, cross-zone validation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from conftest import SMALL
from visiflow import config as C
from visiflow.operators.binning import bin_mean
from visiflow.operators.metrics import cross_zone_metrics, regression_metrics
from visiflow.plans import q_models
from visiflow.plans import training as T
from visiflow.plans.pooled import POOLED_SPEC, fit_pooled, load_pooled, pooled_nowcast, save_pooled, score_newest_pooled, tree_forecast
from visiflow.sources.readings import readings_from_events

GRID = {"n_estimators": [2, 5], "max_depth": [2, 3], "learning_rate": [0.1], "subsample": [0.8], "colsample_bytree": [1.0],
        "min_child_weight": [1], "gamma": [0]}


@pytest.fixture(scope="module")
def made(spark):
    table, zones, spec = q_models._setup(spark, SMALL, POOLED_SPEC)
    return table, zones, T.usable_features(table, spec), spec


def test_draws_that_differ_only_in_trees_share_a_fit():
    draws = T.sample_params(C.PARAM_GRID, C.SEARCH_DRAWS)
    stages = T.staged(draws)
    assert sorted(i for st in stages for i in st.draws) == list(range(len(draws))) == list(range(50))
    for st in stages:
        assert st.params["n_estimators"] == max(draws[i]["n_estimators"] for i in st.draws)
        assert all({**draws[i], "n_estimators": 0} == {**st.params, "n_estimators": 0} for i in st.draws)
    assert len(T.staged(T.sample_params(GRID, 4))) == 2


def test_search_scores_every_draw_as_its_own_fits_would(spark, made):
    table, zones, feats, spec = made
    zone, draws = zones[0], T.sample_params(GRID, 50)
    best, score = T.search(table, {zone: feats[zone]}, GRID, 50, workers=4)[zone]
    rows = T.zone_rows(table, zone, feats[zone], 3)
    r2 = RegressionEvaluator(labelCol="y", predictionCol="pred", metricName="r2")
    want = [np.mean([r2.evaluate(T.pipeline(feats[zone], d, 42).fit(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k))) for k in range(3)])
            for d in draws]
    assert len(draws) == 4 and best == draws[int(np.argmax(want))] and score == pytest.approx(max(want), abs=1e-9)


def test_fits_of_the_search_read_rows_without_the_plan_that_made_them(spark, made, monkeypatch):
    table, zones, feats, spec = made
    seen, fit = [], T.Pipeline.fit

    def watched(self, rows, *given):
        seen.append((rows._jdf.queryExecution().optimizedPlan().toString(), self.getStages()[-1].getCacheNodeIds()))
        return fit(self, rows, *given)

    monkeypatch.setattr(T.Pipeline, "fit", watched)
    T.search(table, {zones[0]: feats[zones[0]]}, GRID, 1, workers=3)
    assert len(seen) == 3
    for plan, cached in seen:
        assert "LogicalRDD" in plan and "Window" not in plan and "InMemoryRelation" not in plan and "parquet" not in plan and not cached


def test_the_whole_training_keeps_every_run(spark, made):
    table, zones, feats, spec = made
    log, best = T.train_all(spark, table, zones[:2], spec, tree_counts=(2, 4, 3), tune=True, grid=GRID, draws=4)
    rows = log.orderBy("zone", "run_order").collect()
    assert [(r.zone, r.method, r.run_order) for r in rows] == [(z, m, k) for z in zones[:2] for k, m in enumerate(["tuned", "fixed", "fixed", "fixed"], 1)]
    assert [r.epoch for r in rows if r.method == "fixed"] == [2, 4, 3] * 2 and all(r.cv_score is not None for r in rows if r.method == "tuned")
    picked = {r.zone: r for r in T.best_runs(log).collect()}
    assert all(picked[z].test_r2 == max(r.test_r2 for r in rows if r.zone == z) == best[z].metrics["test_r2"] for z in zones[:2])


def test_pooled_model_beside_the_models_per_zone(spark, made, tmp_path):
    table, zones, feats, spec = made
    pooled = fit_pooled(table, params={"n_estimators": 10})
    test = table.filter(F.col("split") == "test")
    scored = pooled_nowcast(test, pooled)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") <= 4 and scored.count() == test.count()             # one model in the plan, whatever the number of zones
    got = {r.zone: r.rmse for r in regression_metrics(scored, ["zone"], "y", "predicted").collect()}
    mean = {r.zone: r.s for r in test.groupBy("zone").agg(F.stddev_pop("y").alias("s")).collect()}
    for z in zones:
        own = T.fit_fixed(table, z, feats[z], 10, 1).metrics["test_rmse"]
        assert got[z] < 1.5 * own and got[z] < 2 * mean[z]
    save_pooled(spark, pooled, str(tmp_path / "m"))
    again = pooled_nowcast(test, load_pooled(spark, str(tmp_path / "m")))
    assert again.select("zone", "ts", "predicted").exceptAll(scored.select("zone", "ts", "predicted")).count() == 0
    bins = bin_mean(readings_from_events(spark, SMALL)).select("ts", "zone", "rvr")
    unknown = bins.filter(F.col("zone") == zones[0]).withColumn("zone", F.lit("unseen"))
    assert {r.zone: r.source for r in score_newest_pooled(bins.unionByName(unknown), pooled).collect()} == {**{z: "model" for z in zones}, "unseen": "model"}


def test_tree_forecast_steps_one_by_one(spark, made):
    table, zones, feats, spec = made
    pooled = fit_pooled(table, params={"n_estimators": 4})
    bins = bin_mean(readings_from_events(spark, SMALL)).select("ts", "zone", "rvr")
    few = spark.createDataFrame([(dt.datetime(2024, 1, 1), "few", 500.0)], "ts timestamp_ntz, zone string, rvr double")
    got = sorted(tree_forecast(bins.unionByName(few), pooled, hours=1, cut_every=2).collect(), key=lambda r: (r.zone, r.step))
    assert [(r.zone, r.step) for r in got] == [(z, s) for z in sorted(zones) for s in range(5)]
    start = max(r.ts for r in bins.filter((F.col("rvr") > 0) & (F.col("rvr") < 3333)).collect())
    assert all(r.ts == start + dt.timedelta(minutes=15 * r.step) for r in got)
    zone = zones[0]
    held = [r.rvr for r in bins.filter((F.col("zone") == zone) & (F.col("rvr") > 0) & (F.col("rvr") < 3333)).orderBy(F.col("ts").desc()).limit(3).collect()]
    for r in [x for x in got if x.zone == zone]:
        row = spark.createDataFrame([(zone, r.ts, *held)], "zone string, ts timestamp_ntz, lag_1 double, lag_2 double, lag_3 double")
        from visiflow.functions.times import calendar_columns
        value = pooled_nowcast(row.withColumns({c: calendar_columns("ts")[c].cast("double") for c in spec.calendar}), pooled).first().predicted
        assert r.forecast == pytest.approx(value, abs=0.051)
        held = [value, *held[:2]]


def test_cross_zone_metrics_of_known_lines(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 3.0, 3.0)], "zone string, lag_1 double, y double")
    coefs = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 1.0), ("c", None, None)], "zone string, a double, b double")
    got = {(r.model_zone, r.zone): (r.n, r.rmse, r.mae) for r in cross_zone_metrics(rows, coefs).collect()}
    assert got == {("a", "a"): (2, 0.0, 0.0), ("b", "b"): (2, 0.0, 0.0), ("b", "a"): (2, pytest.approx(np.sqrt(2.5)), 1.5), ("a", "b"): (2, pytest.approx(np.sqrt(5.0)), 2.0)}
