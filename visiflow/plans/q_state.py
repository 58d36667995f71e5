"""State report queries: latest rows, readiness, profiles, horizons, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow.operators.binning import bin_mean, pivot_zones
from visiflow.operators.index import with_positions
from visiflow.operators.state import (column_samples, horizon, last_valid_in_tail, latest_per_key, min_sample_gate, profile,
                                      readiness)
from visiflow.operators.windows import lag_features
from visiflow.plans.catalog import register
from visiflow.plans.q_windows import LAG_SQL
from visiflow.plans.sql import BINS, CELLS, READINGS, with_
from visiflow.sources.readings import readings_from_events


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _bins(spark, sf_dir):
    return bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")


@register("latest_per_zone", with_(READINGS) + """
SELECT zone, max(ts) AS ts, round(arg_max(rvr, ts), 4) AS rvr FROM readings GROUP BY zone
""")
def latest_per_zone(spark, sf_dir):
    """A4: newest reading of every zone (time order, not file order)."""
    out = latest_per_key(readings_from_events(spark, sf_dir), ["zone"])
    return out.select("zone", "ts", r4("rvr").alias("rvr"))


@register("last_valid_per_zone", with_(CELLS) + """,
tail AS (SELECT * FROM cells WHERE pos >= (SELECT max(pos) FROM axis) - 99 AND rvr > 0 AND rvr < 3333.0)
SELECT zone, max(ts) AS ts, round(arg_max(rvr, ts), 4) AS rvr FROM tail GROUP BY zone
""")
def last_valid_per_zone(spark, sf_dir):
    """A5: newest valid bin value per zone within the newest 100 grid rows, with its own time."""
    out = last_valid_in_tail(_bins(spark, sf_dir), 100)
    return out.select("zone", "ts", r4("rvr").alias("rvr"))


@register("zone_readiness", with_(READINGS) + """
SELECT zone, CAST(least(count(*), 4) AS BIGINT) AS data_points, CAST(4 AS BIGINT) AS required,
       count(*) >= 4 AS can_predict, round(arg_max(rvr, ts), 4) AS latest_value, max(ts) AS latest_ts
FROM readings WHERE rvr > 0 AND rvr < 3333.0 GROUP BY zone
""")
def zone_readiness(spark, sf_dir):
    """Valid points held per zone (at most 4), can_predict, latest value and time."""
    out = readiness(readings_from_events(spark, sf_dir))
    return out.select("zone", "data_points", "required", "can_predict", r4("latest_value").alias("latest_value"),
                      "latest_ts")


@register("profile_nonnull", with_(BINS) + """,
wide AS (
  SELECT ts, max(CASE WHEN zone = 'click' THEN rvr END) AS click, max(CASE WHEN zone = 'error' THEN rvr END) AS error,
         max(CASE WHEN zone = 'purchase' THEN rvr END) AS purchase, max(CASE WHEN zone = 'signup' THEN rvr END) AS signup,
         max(CASE WHEN zone = 'view' THEN rvr END) AS "view"
  FROM bins GROUP BY ts
)
SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(click) AS nonnull_click,
       count(error) AS nonnull_error, count(purchase) AS nonnull_purchase, count(signup) AS nonnull_signup,
       count("view") AS nonnull_view
FROM wide
""")
def profile_nonnull(spark, sf_dir):
    """A6 + A7: shape, date range and non-null count of every zone column of the wide table, one pass."""
    wide = pivot_zones(_bins(spark, sf_dir), None)
    return profile(wide)


@register("horizon_window", with_(BINS) + """
SELECT ts, zone, round(rvr, 4) AS rvr FROM bins
WHERE ts >= (SELECT min(ts) FROM bins) AND ts <= (SELECT min(ts) FROM bins) + INTERVAL 12 HOUR
""")
def horizon_window(spark, sf_dir):
    """Rows in [min(ts), min(ts) + 12 h] (scalar subquery start, map-side filter)."""
    out = horizon(_bins(spark, sf_dir), 12)
    return out.select("ts", "zone", r4("rvr").alias("rvr"))


@register("range_filter", with_(READINGS) + """
SELECT ts, zone, round(rvr, 4) AS rvr FROM readings
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'
""")
def range_filter(spark, sf_dir):
    """Inclusive time-range filter, pushed into the parquet scan."""
    r = readings_from_events(spark, sf_dir)
    lo = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    hi = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return r.filter(F.col("ts").between(lo, hi)).select("ts", "zone", r4("rvr").alias("rvr"))


@register("min_sample_gate", "WITH lagged AS (" + LAG_SQL + """)
SELECT zone, count(*) AS n_rows FROM lagged GROUP BY zone HAVING count(*) >= 100
""")
def min_sample_gate_q(spark, sf_dir):
    """Zones with at least 100 complete feature rows (others are not modelled)."""
    rows = min_sample_gate(lag_features(_bins(spark, sf_dir)), ["zone"], 100)
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n_rows"))


@register("grid_cells_positions", with_(CELLS) + """
SELECT zone, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, min(ts) AS first_ts FROM cells GROUP BY zone
""")
def grid_cells_positions(spark, sf_dir):
    """Every bin cell with its grid position (summarised per zone)."""
    cells = with_positions(_bins(spark, sf_dir))
    return cells.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"),
                                     F.min("ts").alias("first_ts"))


@register("profile_samples", with_(BINS) + """,
wide AS (
  SELECT ts, max(CASE WHEN zone = 'click' THEN rvr END) AS click, max(CASE WHEN zone = 'error' THEN rvr END) AS error,
         max(CASE WHEN zone = 'purchase' THEN rvr END) AS purchase, max(CASE WHEN zone = 'signup' THEN rvr END) AS signup,
         max(CASE WHEN zone = 'view' THEN rvr END) AS "view"
  FROM bins GROUP BY ts
)
""" + "\nUNION ALL\n".join(
    f"(SELECT '{z}' AS \"column\", ts, round(\"{z}\", 4) AS value FROM wide WHERE \"{z}\" IS NOT NULL "
    f"ORDER BY ts, \"{z}\" LIMIT 5)" for z in ("click", "error", "purchase", "signup", "view")))
def profile_samples(spark, sf_dir):
    """First five non-null values of every zone column of the wide table (a top-n per column)."""
    wide = pivot_zones(_bins(spark, sf_dir).withColumn("rvr", r4("rvr")), None)
    return column_samples(wide, [c for c in wide.columns if c != "ts"], 5)
