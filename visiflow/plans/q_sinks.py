"""Queries that write through every sink and read back, and the row filters of the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow.functions.values import finite
from visiflow.operators.binning import bin_mean, pivot_zones
from visiflow.operators.metrics import log_summary
from visiflow.plans.catalog import ORACLES, register
from visiflow.plans.cleaning import start_from
from visiflow.plans.pipeline_a import FEATURES, pipeline_a_features
from visiflow.plans.q_metrics import runs_table
from visiflow.plans.q_windows import weather_from_events
from visiflow.plans.sql import BINS, CELLS, READINGS, with_
from visiflow.session import ensure_checkpoint_dir
from visiflow.functions.times import floor_minutes
from visiflow.sources.readings import readings_from_events, select_year, table, time_column
from visiflow.sources.sinks import append_history, append_training_log, write_latest, write_range, write_yearly
from visiflow.streaming.jobs import run_dir


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _bins(spark, sf_dir):
    return bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")


@register("yearly_roundtrip", with_(BINS) + "SELECT ts, zone, round(rvr, 4) AS rvr FROM bins WHERE year(ts) = 2024")
def yearly_roundtrip(spark, sf_dir):
    """S8 + S5: wide yearly table written, one year selected by its partition, back to long."""
    ensure_checkpoint_dir(spark)
    out = run_dir(spark, "yearly")
    write_yearly(pivot_zones(_bins(spark, sf_dir), None), out)
    wide = select_year(spark.read.parquet(out), 2024).drop("year")
    zones = [c for c in wide.columns if c != "ts"]
    long = wide.select("ts", *[F.col(f"`{z}`").cast("double") for z in zones]).unpivot(["ts"], zones, "zone", "rvr")
    return long.filter(F.col("rvr").isNotNull()).select("ts", "zone", r4("rvr").alias("rvr"))


@register("time_column_profile", with_(READINGS) + "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM readings")
def time_column_profile(spark, sf_dir):
    """The time column is found by name and profiled."""
    df = readings_from_events(spark, sf_dir).withColumnRenamed("ts", "Reading DateTime").select("zone", "Reading DateTime", "rvr")
    c = time_column(df)
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("first_ts"), F.max(c).alias("last_ts"))


@register("start_from", with_(READINGS) + """
SELECT strftime(ts, '%Y-%m-%d') AS day, zone, round(rvr, 4) AS rvr FROM readings
WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-10' AND EXISTS (SELECT 1 FROM readings WHERE strftime(ts, '%Y-%m-%d') = '2024-01-10')
""")
def start_from_q(spark, sf_dir):
    """Rows from a given day on, if that day occurs."""
    r = readings_from_events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "zone", r4("rvr").alias("rvr"))
    return start_from(r, "day", "2024-01-10")


@register("finite_targets", """
SELECT event_id, round(value / (user_id % 3), 4) AS target FROM events WHERE user_id % 3 <> 0 AND user_id % 5 <> 0
""")
def finite_targets(spark, sf_dir):
    """Rows whose target is null or infinite go (a share of the stand-in rows is made so)."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 3
    target = F.when(F.col("user_id") % 5 == 0, None).when(k == 0, F.lit(float("inf"))).otherwise(F.col("value") / F.nullif(k, F.lit(0)))
    return e.select("event_id", target.alias("target")).filter(finite(F.col("target"))).select("event_id", r4("target").alias("target"))


@register("history_roundtrip", with_(BINS) + "SELECT ts, zone, round(rvr, 4) AS value, strftime(ts, '%Y-%m-%d') AS run_date FROM bins")
def history_roundtrip(spark, sf_dir):
    """Two appends to the history by run date, read back together."""
    ensure_checkpoint_dir(spark)
    out = run_dir(spark, "history")
    b = _bins(spark, sf_dir)
    for part in (F.hour("ts") < 12, F.hour("ts") >= 12):
        append_history(b.filter(part), out)
    return spark.read.parquet(out).select("ts", "zone", r4("rvr").alias("value"),
                                          F.col("run_date").cast("string").alias("run_date"))


@register("latest_roundtrip", ORACLES.get("latest_per_zone") or with_(READINGS) + """
SELECT zone, max(ts) AS ts, round(arg_max(rvr, ts), 4) AS rvr FROM readings GROUP BY zone
""")
def latest_roundtrip(spark, sf_dir):
    """The latest table, replaced by a second write, read back."""
    ensure_checkpoint_dir(spark)
    out = run_dir(spark, "latest-table")
    r = readings_from_events(spark, sf_dir)
    write_latest(r.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")), out)
    write_latest(r, out)
    return spark.read.parquet(out).select("zone", "ts", r4("rvr").alias("rvr"))


@register("range_csv_roundtrip", with_(BINS) + "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS ts, zone, round(rvr, 4) AS rvr FROM bins")
def range_csv_roundtrip(spark, sf_dir):
    """Batch-range table as CSV with the time as text, read back."""
    ensure_checkpoint_dir(spark)
    out = run_dir(spark, "range")
    write_range(_bins(spark, sf_dir).withColumn("rvr", r4("rvr")), out)
    return (spark.read.option("header", "true").schema("ts string, zone string, rvr double").csv(out)
            .select("ts", "zone", r4("rvr").alias("rvr")))


@register("training_log_roundtrip", ORACLES["training_log_summary"])
def training_log_roundtrip(spark, sf_dir):
    """S13 + A13: the run log appended by zone, read back and summarised."""
    ensure_checkpoint_dir(spark)
    out = run_dir(spark, "training-log")
    append_training_log(runs_table(spark, sf_dir), out)
    return log_summary(spark.read.parquet(out))


WEATHER_10 = """,
weather AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) + INTERVAL 4 MINUTE AS ts, avg(value) AS temperature,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS humidity,
         avg(CAST(user_id % 20 AS DOUBLE)) AS wind_speed,
         avg(value - CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0) AS dew_point
  FROM events GROUP BY 1
)"""


def weather_of_bins(spark, sf_dir):
    """Stand-in weather: the events' figures averaged per 10 minutes, four minutes off the bins."""
    w = weather_from_events(spark, sf_dir)
    per_bin = w.groupBy(floor_minutes("ts").alias("t")).agg(*(F.avg(m).alias(m) for m in ("temperature", "humidity", "wind_speed", "dew_point")))
    return per_bin.withColumn("ts", F.timestamp_add("MINUTE", F.lit(4), F.col("t"))).drop("t")


@register("pipeline_a_features", with_(CELLS) + WEATHER_10 + """,
lagged AS (
  SELECT *, first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_1,
    first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS lag_2,
    first(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS lag_3,
    avg(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3,
    avg(rvr) OVER (PARTITION BY zone ORDER BY pos RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_6
  FROM cells
),
b AS (SELECT l.*, w.ts AS bts FROM lagged l ASOF LEFT JOIN weather w ON l.ts >= w.ts),
f AS (SELECT b.*, w.ts AS fts FROM b ASOF LEFT JOIN weather w ON b.ts <= w.ts),
m AS (
  SELECT f.*, CASE WHEN bts >= ts - INTERVAL 30 MINUTE AND (fts IS NULL OR fts > ts + INTERVAL 30 MINUTE OR ts - bts <= fts - ts) THEN bts
                   WHEN fts <= ts + INTERVAL 30 MINUTE THEN fts END AS wts FROM f
)
SELECT zone, m.ts, round(rvr, 4) AS y, CAST(hour(m.ts) AS BIGINT) AS hour, CAST(isodow(m.ts) - 1 AS BIGINT) AS day_of_week,
  CAST(month(m.ts) AS BIGINT) AS month, CAST(year(m.ts) AS BIGINT) AS year, CAST(dayofyear(m.ts) AS BIGINT) AS day_of_year,
  round(sin(2 * pi() * hour(m.ts) / 24.0), 4) AS hour_sin, round(cos(2 * pi() * hour(m.ts) / 24.0), 4) AS hour_cos,
  round(sin(2 * pi() * month(m.ts) / 12.0), 4) AS month_sin, round(cos(2 * pi() * month(m.ts) / 12.0), 4) AS month_cos,
  round(lag_1, 4) AS lag_1, round(lag_2, 4) AS lag_2, round(lag_3, 4) AS lag_3, round(rolling_3, 4) AS rolling_3,
  round(rolling_6, 4) AS rolling_6, round(temperature, 4) AS temperature, round(humidity, 4) AS humidity,
  round(wind_speed, 4) AS wind_speed, round(dew_point, 4) AS dew_point,
  round(temperature / (humidity + 1e-6), 4) AS temp_humidity_ratio, round(temperature - dew_point, 4) AS temp_dewpoint_diff
FROM m LEFT JOIN weather ON weather.ts = m.wts WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL
""")
def pipeline_a_features_q(spark, sf_dir):
    """J2 + F1-F3 + W1 + W3 + W4: the second pipeline's feature table, windows as in the source system."""
    f = pipeline_a_features(_bins(spark, sf_dir), weather_of_bins(spark, sf_dir), include_current=True)
    whole = {"hour", "day_of_week", "month", "year", "day_of_year"}
    return f.select("zone", "ts", r4("y").alias("y"), *(F.col(c) if c in whole else r4(c).alias(c) for c in FEATURES))
