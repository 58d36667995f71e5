"""Queries of the pooled model, the trees' forecast, cross-zone validation and the second pipeline's model.

The trees' own values have no SQL; the rows, splits, times and counts around them have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.operators.binning import bin_mean
from visiflow.operators.metrics import cross_zone_metrics
from visiflow.operators.windows import temporal_split, valid_lag_features
from visiflow.plans.catalog import register
from visiflow.plans.pipeline_a import FEATURES, pipeline_a_features, pipeline_a_table, train_pipeline_a
from visiflow.plans.pooled import POOLED_SPEC, fit_pooled, load_pooled, pooled_nowcast, save_pooled, score_newest_pooled, tree_forecast
from visiflow.plans.q_models import live_feed
from visiflow.plans.q_sinks import weather_of_bins
from visiflow.plans.scoring import fit_linear_nowcast
from visiflow.plans.sql import BINS, CELLS, with_
from visiflow.plans.training import training_table
from visiflow.session import ensure_checkpoint_dir, materialize, shared_path
from visiflow.sources.readings import readings_from_events
from visiflow.streaming.jobs import run_dir

N_STEPS = C.FORECAST_HOURS * 60 // C.FORECAST_STEP_MIN + 1


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _bins(spark, sf_dir):
    return bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")


VALID_BINS = BINS + """,
valid AS (SELECT ts, zone, rvr, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY zone) AS n,
            lag(rvr) OVER (PARTITION BY zone ORDER BY ts) AS lag_1
          FROM bins WHERE rvr > 0 AND rvr < 3333.0)"""


@register("pooled_nowcast", with_(VALID_BINS) + """
SELECT zone, ts, round(rvr, 4) AS actual, true AS scored FROM valid WHERE n >= 100 AND idx >= floor(n * 0.8)
""")
def pooled_nowcast_q(spark, sf_dir):
    """M4 + M6 + M11 with one model for all zones: the test rows of every zone, scored by one transform."""
    ensure_checkpoint_dir(spark)
    table = training_table(_bins(spark, sf_dir), POOLED_SPEC)
    scored = pooled_nowcast(table.filter(F.col("split") == "test"), fit_pooled(table))
    return scored.select("zone", "ts", r4("y").alias("actual"), F.col("predicted").isNotNull().alias("scored"))


@register("pooled_live_cycle", """
WITH feed AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS zone, value * 10.0 AS rvr FROM events
  UNION ALL SELECT CAST(ts AS TIMESTAMP), 'spare', 3333.0 FROM events WHERE event_type = 'view'
  UNION ALL SELECT CAST(ts AS TIMESTAMP), 'new', value * 10.0 FROM events
            WHERE event_type = 'signup' AND CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-01 06:00:00'
),
b AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, zone, avg(rvr) AS rvr FROM feed GROUP BY 1, 2),
last AS (SELECT zone, max(ts) AS ts, arg_max(rvr, ts) AS current, count(*) AS n FROM b WHERE rvr > 0 AND rvr < 3333.0 GROUP BY zone)
SELECT z.zone, last.ts, round(current, 4) AS current,
  CASE WHEN n > 3 THEN 'model' WHEN current IS NOT NULL THEN 'current' ELSE 'default' END AS source
FROM (SELECT DISTINCT zone FROM b) z LEFT JOIN last USING (zone)
""")
def pooled_live_cycle(spark, sf_dir):
    """M4 + M6 + M7 + S14: fit, save with a registry entry, load, score the newest state of every zone by one transform."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "pooled")
    bins = materialize(bin_mean(live_feed(spark, sf_dir)).select("ts", "zone", "rvr"))
    save_pooled(spark, fit_pooled(training_table(bins, POOLED_SPEC)), base)
    out = score_newest_pooled(bins, load_pooled(spark, base))
    return out.select("zone", "ts", r4("current").alias("current"), "source")


@register("tree_forecast", with_(VALID_BINS) + f"""
SELECT z.zone, k AS step, (SELECT max(ts) FROM valid) + k * INTERVAL {C.FORECAST_STEP_MIN} MINUTE AS ts, true AS has_value
FROM (SELECT zone FROM valid GROUP BY zone HAVING count(*) >= 3) z, range({N_STEPS}) s(k)
""")
def tree_forecast_q(spark, sf_dir):
    """M9 + F8 with boosted trees: 24 hours in steps of 15 minutes for every zone (the values are tested by the first steps)."""
    ensure_checkpoint_dir(spark)
    bins = materialize(_bins(spark, sf_dir))
    out = tree_forecast(bins, fit_pooled(training_table(bins, POOLED_SPEC)))
    return out.select("zone", "step", "ts", F.col("forecast").isNotNull().alias("has_value"))


@register("cross_zone_validation", with_(VALID_BINS) + """,
rows AS (SELECT zone, ts, rvr, lag_1, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY zone) AS m
         FROM valid WHERE lag_1 IS NOT NULL),
coefs AS (SELECT zone AS model_zone, regr_intercept(rvr, lag_1) AS a, regr_slope(rvr, lag_1) AS b FROM rows WHERE i < floor(m * 0.8) GROUP BY zone),
s AS (SELECT model_zone, zone, rvr AS y, a + b * lag_1 AS p FROM rows, coefs WHERE i >= floor(m * 0.8) AND a IS NOT NULL AND b IS NOT NULL)
SELECT model_zone, zone, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae,
  round(CASE WHEN var_pop(y) > 0 THEN 1 - avg((p - y) * (p - y)) / var_pop(y) END, 4) AS r2
FROM s GROUP BY model_zone, zone
""")
def cross_zone_validation(spark, sf_dir):
    """Every zone's AR(1) line, fitted on its train rows, on the test rows of every zone."""
    ensure_checkpoint_dir(spark)
    rows = valid_lag_features(_bins(spark, sf_dir)).filter(F.col("lag_1").isNotNull()).select("zone", "ts", "rvr", "lag_1")
    split = materialize(temporal_split(rows, ["zone"], "ts"))
    coefs = fit_linear_nowcast(split.filter(F.col("split") == "train"))
    out = cross_zone_metrics(split.filter(F.col("split") == "test"), coefs, y="rvr")
    return out.select("model_zone", "zone", "n", *[r4(c).alias(c) for c in ("rmse", "mae", "r2")])


@register("pipeline_a_model", with_(CELLS) + f""",
lagged AS (
  SELECT zone, ts, rvr, first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_1,
    first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS lag_2,
    first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS lag_3
  FROM cells
),
c AS (SELECT zone, count(*) AS n FROM lagged WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL GROUP BY zone HAVING count(*) >= 100)
SELECT zone, 'pipeline_a' AS method, CAST({C.PIPELINE_A_PARAMS['n_estimators']} AS BIGINT) AS epoch, CAST(floor(n * 0.8) AS BIGINT) AS n_train,
  n - CAST(floor(n * 0.8) AS BIGINT) AS n_test, '{",".join(FEATURES)}' AS features, true AS has_metrics
FROM c
""")
def pipeline_a_model(spark, sf_dir):
    """M2 + J2: the second pipeline's fixed model (200 trees) on as-of weather features, its own split and imputation."""
    ensure_checkpoint_dir(spark)
    f = pipeline_a_features(_bins(spark, sf_dir), weather_of_bins(spark, sf_dir))
    log = train_pipeline_a(spark, pipeline_a_table(f, shared_path(spark, f"visiflow-train/a-{run_dir(spark, 'a')[-8:]}")))
    whole = F.forall(F.array(*[F.col(c) for c in log.columns if c.startswith(("train_", "test_"))]), lambda x: x.isNotNull())
    return log.select("zone", "method", "epoch", "n_train", "n_test", "features", whole.alias("has_metrics"))
