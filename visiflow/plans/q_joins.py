"""Join queries: feed equi-join, as-of joins, cross-zone features, union of feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow.operators.asof import asof_join
from visiflow.operators.binning import bin_mean, resample_per_source
from visiflow.operators.joins import cross_zone_features, feed_join, union_feeds
from visiflow.plans.catalog import register
from visiflow.plans.sql import BINS, READINGS, with_
from visiflow.sources.readings import readings_from_events, table


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _feeds(spark, sf_dir):
    """Two stand-in weather feeds: parameters (even user ids) and wind (odd user ids)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    base = e.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("runway"),
                    F.col("user_id"), F.col("value"), k.alias("k"))
    para = base.filter(F.col("user_id") % 2 == 0).select(
        "ts", "runway", F.col("value").alias("temperature"), F.col("k").alias("humidity"),
        F.lit("para").alias("source_file"))
    wind = base.filter(F.col("user_id") % 2 == 1).select(
        "ts", "runway", F.col("value").alias("wind_speed"), F.col("k").alias("humidity"),
        F.lit("wind").alias("source_file"))
    return para, wind


FEEDS_SQL = """
base AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS runway, user_id, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
),
para AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, runway, avg(value) AS temperature, avg(k) AS humidity
  FROM base WHERE user_id % 2 = 0 GROUP BY 1, 2
),
wind AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, runway, avg(value) AS wind_speed, avg(k) AS humidity
  FROM base WHERE user_id % 2 = 1 GROUP BY 1, 2
)"""


@register("feed_inner_join", with_(FEEDS_SQL) + """
SELECT p.ts, p.runway, round(p.temperature, 4) AS temperature, round(p.humidity, 4) AS humidity_para,
       round(w.wind_speed, 4) AS wind_speed, round(w.humidity, 4) AS humidity_wind
FROM para p JOIN wind w ON p.runway = w.runway AND p.ts = w.ts
""")
def feed_inner_join(spark, sf_dir):
    """A3 + J1: each feed resampled to 10-minute means, then inner-joined on (runway, ts).

    Overlapping measure names get the suffixes _para / _wind.
    """
    para, wind = _feeds(spark, sf_dir)
    p = resample_per_source(para, ["temperature", "humidity"], keys=["runway"], per_source=False)
    w = resample_per_source(wind, ["wind_speed", "humidity"], keys=["runway"], per_source=False)
    j = feed_join(p, w, ["runway", "ts"], suffixes=("_para", "_wind"))
    return j.select("ts", "runway", r4("temperature").alias("temperature"), r4("humidity_para").alias("humidity_para"),
                    r4("wind_speed").alias("wind_speed"), r4("humidity_wind").alias("humidity_wind"))


@register("resample_per_file", with_(FEEDS_SQL) + """
SELECT ts, runway, source_file, round(temperature, 4) AS temperature, round(wind_speed, 4) AS wind_speed,
       round(humidity, 4) AS humidity FROM (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, runway,
         CASE WHEN user_id % 2 = 0 THEN 'para' ELSE 'wind' END AS source_file,
         avg(CASE WHEN user_id % 2 = 0 THEN value END) AS temperature,
         avg(CASE WHEN user_id % 2 = 1 THEN value END) AS wind_speed, avg(k) AS humidity
  FROM base GROUP BY 1, 2, 3
) WHERE coalesce(temperature, wind_speed, humidity) IS NOT NULL
""")
def resample_per_file(spark, sf_dir):
    """A3 + U1: feeds unioned by name, resampled per source file (a bin split over files stays two rows)."""
    para, wind = _feeds(spark, sf_dir)
    u = union_feeds([para, wind])
    out = resample_per_source(u, ["temperature", "wind_speed", "humidity"], keys=["runway"],
                              source="source_file", per_source=True)
    return out.select("ts", "runway", "source_file", r4("temperature").alias("temperature"),
                      r4("wind_speed").alias("wind_speed"), r4("humidity").alias("humidity"))


@register("union_feeds", """
SELECT source, count(*) AS n, count(temperature) AS n_temperature, count(wind_speed) AS n_wind_speed,
       round(sum(humidity), 4) AS sum_humidity
FROM (
  SELECT 'para' AS source, value AS temperature, NULL AS wind_speed,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity FROM events WHERE user_id % 2 = 0
  UNION ALL BY NAME
  SELECT 'wind' AS source, value AS wind_speed, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity
  FROM events WHERE user_id % 2 = 1
) GROUP BY source
""")
def union_feeds_q(spark, sf_dir):
    """Union by column name, columns missing on one side are NULL."""
    para, wind = _feeds(spark, sf_dir)
    u = union_feeds([para.withColumn("source", F.lit("para")).drop("source_file"),
                     wind.withColumn("source", F.lit("wind")).drop("source_file")])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("temperature").alias("n_temperature"),
                                   F.count("wind_speed").alias("n_wind_speed"),
                                   r4(F.sum("humidity")).alias("sum_humidity"))


def _two_feeds(spark, sf_dir):
    """10-minute bins of every zone from two halves of the feed (even and odd user ids)."""
    e = table(spark, sf_dir, "events")
    half = lambda k: bin_mean(e.filter(F.col("user_id") % 2 == k).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("zone"), (F.col("value") * 10.0).alias("rvr"))).select("ts", "zone", "rvr")
    return half(0), half(1)


ASOF_NEAREST_SQL = """
WITH half AS (
  SELECT user_id % 2 AS k, event_type AS zone, time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) AS ts, avg(value * 10.0) AS rvr
  FROM events GROUP BY 1, 2, 3
),
l AS (SELECT * FROM half WHERE k = 0),
r AS (SELECT * FROM half WHERE k = 1),
c AS (
  SELECT l.zone, l.ts, r.ts AS rts, r.rvr AS rrvr,
         row_number() OVER (PARTITION BY l.zone, l.ts ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), r.ts) AS rn
  FROM l JOIN r ON l.zone = r.zone AND r.ts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 30 MINUTE
)
SELECT l.zone, l.ts, round(l.rvr, 4) AS rvr, c.rts AS right_ts, round(c.rrvr, 4) AS right_rvr
FROM l LEFT JOIN c ON l.zone = c.zone AND l.ts = c.ts AND c.rn = 1
"""


@register("asof_nearest_30m", ASOF_NEAREST_SQL)
def asof_nearest_30m(spark, sf_dir):
    """Nearest as-of join within 30 minutes over the bins of every zone; equal distance -> earlier right row."""
    left, right = _two_feeds(spark, sf_dir)
    j = asof_join(left, right, "ts", by=["zone"], tolerance_minutes=30, direction="nearest")
    return j.select("zone", "ts", r4("rvr").alias("rvr"), "right_ts", r4("right_rvr").alias("right_rvr"))


@register("asof_backward", with_(READINGS) + """,
b AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, zone, avg(rvr) AS rvr FROM readings GROUP BY 1, 2),
j AS (
  SELECT b.ts, b.zone, b.rvr, r.ts AS rts, r.rvr AS rrvr
  FROM b ASOF LEFT JOIN readings r ON b.zone = r.zone AND b.ts >= r.ts
)
SELECT ts, zone, round(rvr, 4) AS rvr,
  CASE WHEN rts >= ts - INTERVAL 30 MINUTE THEN rts END AS right_ts,
  round(CASE WHEN rts >= ts - INTERVAL 30 MINUTE THEN rrvr END, 4) AS right_rvr
FROM j
""")
def asof_backward(spark, sf_dir):
    """Backward as-of by zone within 30 min: last raw reading at or before each bin start."""
    r = readings_from_events(spark, sf_dir)
    b = bin_mean(r).select("ts", "zone", "rvr")
    j = asof_join(b, r, "ts", by=["zone"], tolerance_minutes=30, direction="backward")
    return j.select("ts", "zone", r4("rvr").alias("rvr"), "right_ts", r4("right_rvr").alias("right_rvr"))


@register("asof_forward", with_(READINGS) + """,
b AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, zone, avg(rvr) AS rvr FROM readings GROUP BY 1, 2),
j AS (
  SELECT b.ts, b.zone, b.rvr, r.ts AS rts, r.rvr AS rrvr
  FROM b ASOF LEFT JOIN readings r ON b.zone = r.zone AND b.ts <= r.ts
)
SELECT ts, zone, round(rvr, 4) AS rvr, rts AS right_ts, round(rrvr, 4) AS right_rvr FROM j
""")
def asof_forward(spark, sf_dir):
    """Forward as-of by zone without tolerance: first raw reading at or after each bin start."""
    r = readings_from_events(spark, sf_dir)
    b = bin_mean(r).select("ts", "zone", "rvr")
    j = asof_join(b, r, "ts", by=["zone"], tolerance_minutes=None, direction="forward")
    return j.select("ts", "zone", r4("rvr").alias("rvr"), "right_ts", r4("right_rvr").alias("right_rvr"))


@register("cross_zone_features", with_(BINS) + """,
zr AS (SELECT zone, row_number() OVER (ORDER BY zone) AS zrank FROM (SELECT DISTINCT zone FROM bins)),
wide AS (
  SELECT b.ts,
    max(CASE WHEN zr.zrank = 1 THEN b.rvr END) AS v1, max(CASE WHEN zr.zrank = 2 THEN b.rvr END) AS v2,
    max(CASE WHEN zr.zrank = 3 THEN b.rvr END) AS v3, max(CASE WHEN zr.zrank = 4 THEN b.rvr END) AS v4,
    max(CASE WHEN zr.zrank = 5 THEN b.rvr END) AS v5, max(CASE WHEN zr.zrank = 6 THEN b.rvr END) AS v6
  FROM bins b JOIN zr USING (zone) GROUP BY b.ts
)
SELECT b.ts, b.zone, round(b.rvr, 4) AS rvr,
  round(list_value(v1, v2, v3, v4, v5, v6)[CASE WHEN zr.zrank <= 1 THEN 2 ELSE 1 END], 4) AS other_1,
  round(list_value(v1, v2, v3, v4, v5, v6)[CASE WHEN zr.zrank <= 2 THEN 3 ELSE 2 END], 4) AS other_2,
  round(list_value(v1, v2, v3, v4, v5, v6)[CASE WHEN zr.zrank <= 3 THEN 4 ELSE 3 END], 4) AS other_3,
  round(list_value(v1, v2, v3, v4, v5, v6)[CASE WHEN zr.zrank <= 4 THEN 5 ELSE 4 END], 4) AS other_4,
  round(list_value(v1, v2, v3, v4, v5, v6)[CASE WHEN zr.zrank <= 5 THEN 6 ELSE 5 END], 4) AS other_5
FROM bins b JOIN zr USING (zone) JOIN wide USING (ts)
""")
def cross_zone_features_q(spark, sf_dir):
    """Values of the first five other zones (sorted by name) at the same bin time."""
    b = bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")
    out = cross_zone_features(b, k=5)
    return out.select("ts", "zone", r4("rvr").alias("rvr"), *[r4(f"other_{i}").alias(f"other_{i}") for i in range(1, 6)])
