"""Grid, window and calendar queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from visiflow.functions.times import calendar_columns, cyclic_columns
from visiflow.functions.weather import dew_point_spread, relative_humidity, temp_humidity_ratio, wind_components
from visiflow.operators.binning import bin_mean
from visiflow.operators.index import position_axis, with_positions
from visiflow.operators.windows import (cv_folds, grid_features, lag_features, last_n, temporal_split,
                                        valid_lag_features)
from visiflow.plans.catalog import register
from visiflow.plans.sql import BINS, CELLS, VALID, with_
from visiflow.sources.readings import readings_from_events, table


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _bins(spark, sf_dir):
    return bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")


@register("grid_index", with_(BINS) + """
SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM bins)
""")
def grid_index(spark, sf_dir):
    """J4 (axis): dense position of every distinct bin time, numbered in parallel day chunks."""
    return position_axis(_bins(spark, sf_dir))


@register("zone_grid", with_(CELLS) + """,
tot AS (SELECT count(*) AS n_positions FROM axis)
SELECT zone, max(tot.n_positions) AS n_positions, count(*) AS n_filled,
       max(tot.n_positions) - count(*) AS n_missing, min(pos) AS first_pos, max(pos) AS last_pos
FROM cells, tot GROUP BY zone
""")
def zone_grid(spark, sf_dir):
    """Grid coverage per zone (positions, filled and missing cells) without building the grid.

    The grid is (distinct bin times) x zones; a missing cell is the count
    difference, so no cross join is materialised.
    """
    cells = with_positions(_bins(spark, sf_dir))
    per_zone = cells.groupBy("zone").agg(F.count(F.lit(1)).alias("n_filled"),
                                         F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    # every position holds at least one zone's cell, so the axis length is the
    # largest last position + 1; the window runs over the per-zone table only
    n_pos = (F.max("last_pos").over(Window.partitionBy(F.lit(0))) + 1).cast("bigint")
    return (per_zone.withColumn("n_positions", n_pos)
            .select("zone", "n_positions", "n_filled", (F.col("n_positions") - F.col("n_filled")).alias("n_missing"),
                    "first_pos", "last_pos"))


LAG_SQL = with_(CELLS) + """
SELECT * FROM (
  SELECT ts, zone, round(rvr, 4) AS rvr,
    round(first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 4) AS lag_1,
    round(first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING), 4) AS lag_2,
    round(first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 4) AS lag_3
  FROM cells
) WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL
"""


@register("lag_features", LAG_SQL)
def lag_features_q(spark, sf_dir):
    """W1 + W4: positional lags 1..3 on the zone grid, rows with a missing lag dropped."""
    out = lag_features(_bins(spark, sf_dir))
    return out.select("ts", "zone", r4("rvr").alias("rvr"), *[r4(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 3)])


def _roll_sql(include_current: bool) -> str:
    parts = []
    for w in (3, 6, 12):
        lo, hi = (f"{w - 1} PRECEDING", "CURRENT ROW") if include_current else (f"{w} PRECEDING", "1 PRECEDING")
        frame = f"(PARTITION BY zone ORDER BY pos RANGE BETWEEN {lo} AND {hi})"
        parts.append(f"round(CASE WHEN count(rvr) OVER {frame} >= {w} THEN avg(rvr) OVER {frame} END, 4) AS roll_mean_{w}")
        parts.append(f"round(CASE WHEN count(rvr) OVER {frame} >= {w} THEN stddev_samp(rvr) OVER {frame} END, 4) "
                     f"AS roll_std_{w}")
    return with_(CELLS) + "SELECT ts, zone, round(rvr, 4) AS rvr, " + ", ".join(parts) + " FROM cells"


def _rolling(spark, sf_dir, include_current):
    cells = with_positions(_bins(spark, sf_dir))
    out = grid_features(cells, lags=(), strict_windows=(3, 6, 12), include_current=include_current)
    cols = [r4(f"roll_{s}_{w}").alias(f"roll_{s}_{w}") for w in (3, 6, 12) for s in ("mean", "std")]
    return out.select("ts", "zone", r4("rvr").alias("rvr"), *cols)


@register("rolling_strict", _roll_sql(True))
def rolling_strict(spark, sf_dir):
    """Rolling mean / sample std over 3, 6, 12 grid positions incl. the current row; full windows only."""
    return _rolling(spark, sf_dir, True)


@register("rolling_previous", _roll_sql(False))
def rolling_previous(spark, sf_dir):
    """W2 without look-ahead: the same windows ending one position before the current row."""
    return _rolling(spark, sf_dir, False)


@register("rolling_lenient", with_(CELLS) + """
SELECT ts, zone, round(rvr, 4) AS rvr,
  round(avg(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS roll_mean_3_lenient,
  round(avg(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS roll_mean_6_lenient
FROM cells
""")
def rolling_lenient(spark, sf_dir):
    """Rolling means 3 and 6 with at least one value (min_periods=1)."""
    cells = with_positions(_bins(spark, sf_dir))
    out = grid_features(cells, lags=(), strict_windows=(), lenient_windows=(3, 6))
    return out.select("ts", "zone", r4("rvr").alias("rvr"), r4("roll_mean_3_lenient").alias("roll_mean_3_lenient"),
                      r4("roll_mean_6_lenient").alias("roll_mean_6_lenient"))


@register("calendar_features", with_(BINS) + """
SELECT ts, zone, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
  CAST(month(ts) AS BIGINT) AS month, CAST(dayofyear(ts) AS BIGINT) AS day_of_year, CAST(year(ts) AS BIGINT) AS year,
  round(sin(2 * pi() * hour(ts) / 24.0), 4) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 4) AS hour_cos,
  round(sin(2 * pi() * month(ts) / 12.0), 4) AS month_sin, round(cos(2 * pi() * month(ts) / 12.0), 4) AS month_cos
FROM bins
""")
def calendar_features(spark, sf_dir):
    """F1 + F2: calendar fields (Monday = 0) and cyclic encodings per bin."""
    b = _bins(spark, sf_dir)
    cyc = {k: r4(v) for k, v in cyclic_columns("ts").items()}
    return b.select("ts", "zone", *[v.alias(k) for k, v in calendar_columns("ts").items()],
                    *[v.alias(k) for k, v in cyc.items()])


WEATHER_SQL = """
WITH w AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS runway, value AS temperature,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity,
         value - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 AS dew_point,
         CAST(user_id % 20 AS DOUBLE) AS wind_speed, CAST(event_id % 360 AS DOUBLE) AS wind_dir
  FROM events
)
SELECT ts, runway, round(temperature / (humidity + 1e-6), 4) AS temp_humidity_ratio,
  round(temperature - dew_point, 4) AS dew_point_spread,
  round(wind_speed * sin(radians(wind_dir)), 4) AS wind_u, round(wind_speed * cos(radians(wind_dir)), 4) AS wind_v,
  round(100.0 * exp(17.625 * dew_point / (243.04 + dew_point)) / exp(17.625 * temperature / (243.04 + temperature)), 4)
    AS rel_humidity
FROM w
"""


def weather_from_events(spark, sf_dir):
    """Stand-in weather feed in the canonical schema (column renames and scaling only)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return e.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("runway"),
                    F.col("value").alias("temperature"), k.alias("humidity"),
                    (F.col("value") - k / 10.0).alias("dew_point"),
                    (F.col("user_id") % 20).cast("double").alias("wind_speed"),
                    (F.col("event_id") % 360).cast("double").alias("wind_dir"))


@register("weather_features", WEATHER_SQL)
def weather_features(spark, sf_dir):
    """F3 (+ D2, D3): temperature/humidity ratio, dew-point spread, wind components, relative humidity."""
    w = weather_from_events(spark, sf_dir)
    u, v = wind_components("wind_speed", "wind_dir")
    return w.select("ts", "runway", r4(temp_humidity_ratio("temperature", "humidity")).alias("temp_humidity_ratio"),
                    r4(dew_point_spread("temperature", "dew_point")).alias("dew_point_spread"),
                    r4(u).alias("wind_u"), r4(v).alias("wind_v"),
                    r4(relative_humidity("temperature", "dew_point")).alias("rel_humidity"))


@register("temporal_split", with_(BINS) + """
SELECT ts, zone, CASE WHEN rn < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT ts, zone, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS rn,
             count(*) OVER (PARTITION BY zone) AS n FROM bins)
""")
def temporal_split_q(spark, sf_dir):
    """The first floor(0.8 n) bins of each zone are train, the rest test."""
    return temporal_split(_bins(spark, sf_dir)).select("ts", "zone", "split")


@register("cv_folds", with_(BINS) + """
SELECT ts, zone, CAST(ntile(3) OVER (PARTITION BY zone ORDER BY ts) - 1 AS BIGINT) AS fold FROM bins
""")
def cv_folds_q(spark, sf_dir):
    """Contiguous 3-fold assignment per zone in time order (ntile semantics)."""
    return cv_folds(_bins(spark, sf_dir)).select("ts", "zone", "fold")


@register("valid_lag_features", with_(VALID) + """
SELECT ts, zone, round(rvr, 4) AS rvr,
  round(lag(rvr, 1) OVER w, 4) AS lag_1, round(lag(rvr, 2) OVER w, 4) AS lag_2, round(lag(rvr, 3) OVER w, 4) AS lag_3,
  vidx >= 3 AS ready
FROM valid WINDOW w AS (PARTITION BY zone ORDER BY ts)
""")
def valid_lag_features_q(spark, sf_dir):
    """Lags over valid readings only; ready once a zone has four valid readings."""
    out = valid_lag_features(readings_from_events(spark, sf_dir))
    return out.select("ts", "zone", r4("rvr").alias("rvr"), *[r4(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 3)],
                      "ready")


@register("history_last_100", with_(BINS) + """
SELECT ts, zone, round(rvr, 4) AS rvr, rank_from_end FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ts DESC) AS rank_from_end FROM bins
) WHERE rank_from_end <= 100
""")
def history_last_100(spark, sf_dir):
    """Newest 100 bins of each zone."""
    out = last_n(_bins(spark, sf_dir), 100)
    return out.select("ts", "zone", r4("rvr").alias("rvr"), "rank_from_end")


def _feature_sql() -> str:
    """Oracle for the full training feature table (previous-row windows, other zones at the previous position)."""
    rolls = []
    for w in (3, 6, 12):
        frame = f"(PARTITION BY zone ORDER BY pos RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        rolls.append(f"round(CASE WHEN count(rvr) OVER {frame} >= {w} THEN avg(rvr) OVER {frame} END, 4) AS roll_mean_{w}")
        rolls.append(f"round(CASE WHEN count(rvr) OVER {frame} >= {w} THEN stddev_samp(rvr) OVER {frame} END, 4) "
                     f"AS roll_std_{w}")
    lags = [f"round(first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING), 4) "
            f"AS lag_{k}" for k in (1, 2, 3)]
    others = [f"round(list_value(v1, v2, v3, v4, v5, v6)[CASE WHEN zr.zrank <= {i} THEN {i + 1} ELSE {i} END], 4) "
              f"AS other_{i}" for i in range(1, 6)]
    return with_(CELLS) + """,
zr AS (SELECT zone, row_number() OVER (ORDER BY zone) AS zrank FROM (SELECT DISTINCT zone FROM bins)),
wide AS (
  SELECT b.pos + 1 AS next_pos,
    max(CASE WHEN zr.zrank = 1 THEN b.rvr END) AS v1, max(CASE WHEN zr.zrank = 2 THEN b.rvr END) AS v2,
    max(CASE WHEN zr.zrank = 3 THEN b.rvr END) AS v3, max(CASE WHEN zr.zrank = 4 THEN b.rvr END) AS v4,
    max(CASE WHEN zr.zrank = 5 THEN b.rvr END) AS v5, max(CASE WHEN zr.zrank = 6 THEN b.rvr END) AS v6
  FROM cells b JOIN zr USING (zone) GROUP BY b.pos
)
SELECT c.zone, c.ts, round(c.rvr, 4) AS y, CAST(hour(c.ts) AS DOUBLE) AS hour,
  CAST(isodow(c.ts) - 1 AS DOUBLE) AS day_of_week, CAST(month(c.ts) AS DOUBLE) AS month,
  CAST(dayofyear(c.ts) AS DOUBLE) AS day_of_year, """ + ", ".join(lags + rolls + others) + """
FROM cells c JOIN zr USING (zone) LEFT JOIN wide ON wide.next_pos = c.pos
"""


@register("feature_table", _feature_sql())
def feature_table(spark, sf_dir):
    """W1 + W2 + J6 + F1: the training feature table of every bin in one build (the per-update processing step).

    Calendar fields, positional lags 1..3, full-window rolling mean / std over
    the 3, 6, 12 positions before the row, and the first five other zones at
    the previous position, from one FeatureSpec.
    """
    from visiflow.plans.features import FeatureSpec, build_features
    spec = FeatureSpec(kind="grid", include_current=False, n_other=5, cross_zone_lag=1)
    f = build_features(_bins(spark, sf_dir), spec)
    return f.select("zone", "ts", r4("y").alias("y"), *[r4(c).alias(c) if not c.startswith(("hour", "day", "month"))
                                                        else F.col(c) for c in spec.columns()])
