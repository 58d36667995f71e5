"""Scoring queries with a deterministic (closed-form) model, checkable in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow.functions.names import safe_zone
from visiflow.operators.binning import bin_mean
from visiflow.operators.windows import valid_lag_features
from visiflow.plans.catalog import register
from visiflow.plans.scoring import (fit_linear_nowcast, latest_nowcast, linear_ar_forecast, prediction_record,
                                    range_backfill, system_status)
from visiflow.plans.sql import BINS, with_
from visiflow.session import materialize
from visiflow.sources.readings import readings_from_events


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _bins(spark, sf_dir):
    return bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")


STATE_SQL = BINS + """,
valid_state AS (
  SELECT ts, zone, rvr, lag(rvr, 1) OVER w AS lag_1, lag(rvr, 2) OVER w AS lag_2, lag(rvr, 3) OVER w AS lag_3,
         row_number() OVER w - 1 >= 3 AS ready
  FROM bins WHERE rvr > 0 AND rvr < 3333.0 WINDOW w AS (PARTITION BY zone ORDER BY ts)
),
coefs AS (
  SELECT zone, regr_intercept(rvr, lag_1) AS a, regr_slope(rvr, lag_1) AS b
  FROM valid_state WHERE lag_1 IS NOT NULL GROUP BY zone
)"""

START, END = "2024-01-15 00:00:00", "2024-12-31 23:59:59"

BACKFILL_SQL = STATE_SQL + f""",
past AS (
  SELECT zone, regr_intercept(rvr, lag_1) AS a, regr_slope(rvr, lag_1) AS b
  FROM valid_state WHERE lag_1 IS NOT NULL AND ts < TIMESTAMP '{START}' GROUP BY zone
),
steps AS (SELECT ts, zone, rvr AS raw FROM bins WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
j AS (
  SELECT s.ts, s.zone, s.raw, v.rvr AS current, v.lag_1, coalesce(v.ready, false) AS ready
  FROM steps s ASOF LEFT JOIN valid_state v ON s.zone = v.zone AND s.ts >= v.ts
),
scored AS (
  SELECT j.*, CASE WHEN j.ready AND c.a IS NOT NULL AND c.b IS NOT NULL THEN c.a + c.b * j.lag_1 END AS predicted
  FROM j LEFT JOIN past c USING (zone)
),
backfill AS (
  SELECT ts, zone, current, predicted,
    coalesce(predicted, current, 1000.0) AS value,
    CASE WHEN predicted IS NOT NULL THEN 'model' WHEN current IS NOT NULL THEN 'current' ELSE 'default' END AS source,
    CASE WHEN raw IS NULL OR raw = 3333.0 THEN 1000.0 ELSE raw END AS raw_current
  FROM scored
)"""


def _backfill(spark, sf_dir):
    lo = F.lit(START).cast("timestamp_ntz")
    hi = F.lit(END).cast("timestamp_ntz")
    return range_backfill(_bins(spark, sf_dir), lo, hi)


@register("range_backfill", with_(BACKFILL_SQL) + """
SELECT ts, zone, round(value, 4) AS value, source, round(current, 4) AS current, round(raw_current, 4) AS raw_current
FROM backfill
""")
def range_backfill_q(spark, sf_dir):
    """P13 + M8 + M7: nowcast every bin in a time range from the state as of that bin, with fallback."""
    b = _backfill(spark, sf_dir)
    return b.select("ts", "zone", r4("value").alias("value"), "source", r4("current").alias("current"),
                    r4("raw_current").alias("raw_current"))


@register("fallback_chain", with_(STATE_SQL) + """,
last AS (SELECT zone, max(ts) AS ts, arg_max(rvr, ts) AS current, arg_max(lag_1, ts) AS lag_1,
                arg_max(ready, ts) AS ready FROM valid_state GROUP BY zone),
z AS (SELECT DISTINCT zone FROM bins),
s AS (
  SELECT z.zone, l.ts, l.current,
         CASE WHEN coalesce(l.ready, false) AND c.a IS NOT NULL AND c.b IS NOT NULL THEN c.a + c.b * l.lag_1 END AS predicted
  FROM z LEFT JOIN last l USING (zone) LEFT JOIN coefs c USING (zone)
)
SELECT zone, ts, round(current, 4) AS current, round(predicted, 4) AS predicted,
  round(coalesce(predicted, current, 1000.0), 4) AS value,
  CASE WHEN predicted IS NOT NULL THEN 'model' WHEN current IS NOT NULL THEN 'current' ELSE 'default' END AS source
FROM s
""")
def fallback_chain_q(spark, sf_dir):
    """M6 + M7 + J7: latest nowcast per zone, falling back to the current valid reading, then 1000."""
    out = latest_nowcast(_bins(spark, sf_dir))
    return out.select("zone", "ts", r4("current").alias("current"), r4("predicted").alias("predicted"),
                      r4("value").alias("value"), "source")


@register("prediction_wide", with_(BACKFILL_SQL) + """
SELECT ts,
""" + ",\n".join(
    f"  round(coalesce(max(CASE WHEN zone = '{z}' THEN value END), 1000.0), 4) AS {z}_predicted,\n"
    f"  round(coalesce(max(CASE WHEN zone = '{z}' THEN raw_current END), 1000.0), 4) AS {z}_current"
    for z in ("click", "error", "purchase", "signup", "view")) + """
FROM backfill GROUP BY ts
""")
def prediction_wide(spark, sf_dir):
    """S10 record shape: one row per time, <zone>_predicted and <zone>_current (missing -> 1000)."""
    b = _backfill(spark, sf_dir).withColumn("zone_id", safe_zone("zone"))
    zones = sorted(r[0] for r in b.select("zone_id").distinct().collect())      # the zone dimension
    w = prediction_record(b, zones)
    return w.select("ts", *[r4(c).alias(c) for c in w.columns if c != "ts"])


@register("system_status", with_(BACKFILL_SQL) + """
SELECT (SELECT max(ts) FROM backfill) AS last_update, (SELECT count(*) FROM backfill) AS predictions_kept,
       (SELECT count(DISTINCT zone) FROM past) AS models_available,
       (SELECT count(DISTINCT zone) FROM readings) AS feeds_available,
       (SELECT count(*) FROM readings WHERE rvr > 0 AND rvr < 3333.0) AS valid_readings
""")
def system_status_q(spark, sf_dir):
    """Last update, predictions kept, models available and feeds with data."""
    r = readings_from_events(spark, sf_dir)
    b = bin_mean(r).select("ts", "zone", "rvr")
    state = materialize(valid_lag_features(b))      # read by the fit and by the backfill
    lo = F.lit(START).cast("timestamp_ntz")
    coefs = fit_linear_nowcast(state.filter(F.col("ts") < lo))
    hi = F.lit(END).cast("timestamp_ntz")
    bf = range_backfill(b, lo, hi, coefs, state=state)
    return system_status(bf, coefs, r)


@register("linear_ar_forecast", "WITH RECURSIVE " + STATE_SQL.strip() + """,
last AS (SELECT zone, (SELECT max(ts) FROM bins) AS ts, arg_max(rvr, ts) AS v FROM bins WHERE rvr IS NOT NULL GROUP BY zone),
f(zone, step, ts, v) AS (
  SELECT l.zone, 0, l.ts, c.a + c.b * l.v FROM last l JOIN coefs c USING (zone)
  UNION ALL
  SELECT f.zone, f.step + 1, f.ts + INTERVAL 15 MINUTE, c.a + c.b * f.v FROM f JOIN coefs c USING (zone)
  WHERE f.step < 96
)
SELECT zone, CAST(step AS BIGINT) AS step, ts, round(v, 1) AS forecast FROM f
""")
def linear_ar_forecast_q(spark, sf_dir):
    """M9 + F8 + P23: 24 h AR(1) forecast at 15-minute steps from one common start, rounded to 0.1."""
    b = _bins(spark, sf_dir)
    coefs = fit_linear_nowcast(valid_lag_features(b))
    return linear_ar_forecast(b, coefs, 24, 15)
