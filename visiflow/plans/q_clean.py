"""Cleaning queries: binning, validity, status bands, parsing, names, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow.functions.names import normalize_log_zone, normalize_weather_runway, safe_zone, zone_from_safe
from visiflow.functions.times import parse_ts
from visiflow.functions.values import current_value, is_valid, status_band, status_color
from visiflow.operators.binning import bin_mean, pivot_zones
from visiflow.plans.catalog import register
from visiflow.plans.sql import BINS, READINGS, with_
from visiflow.sources.readings import parse_log_lines, readings_from_events, table


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


@register("bin_mean_10min", with_(BINS) + """
SELECT ts, zone, round(rvr, 4) AS rvr, n_readings, round(sentinel_share, 4) AS sentinel_share FROM bins
""")
def bin_mean_10min(spark, sf_dir):
    """A1: 10-minute mean per zone, reading count and sentinel share."""
    b = bin_mean(readings_from_events(spark, sf_dir))
    return b.select("ts", "zone", r4("rvr").alias("rvr"), F.col("n_readings").cast("bigint").alias("n_readings"),
                    r4("sentinel_share").alias("sentinel_share"))


@register("bin_mean_drop_sentinel", with_(READINGS) + """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, zone,
       round(avg(CASE WHEN rvr = 3333.0 THEN NULL ELSE rvr END), 4) AS rvr
FROM readings GROUP BY 1, 2
""")
def bin_mean_drop_sentinel(spark, sf_dir):
    """A1 with sentinel='drop': off-scale readings do not enter the mean."""
    b = bin_mean(readings_from_events(spark, sf_dir), sentinel="drop")
    return b.select("ts", "zone", r4("rvr").alias("rvr"))


@register("status_band_counts", with_(BINS) + """
SELECT zone,
  CASE WHEN rvr >= 800 THEN 'Good' WHEN rvr >= 500 THEN 'Moderate' WHEN rvr >= 200 THEN 'Poor' ELSE 'Very Poor' END AS status,
  CASE WHEN rvr >= 800 THEN 'green' WHEN rvr >= 500 THEN 'orange' WHEN rvr >= 200 THEN 'red' ELSE 'darkred' END AS color,
  count(*) AS n_bins, round(avg(rvr), 4) AS avg_rvr
FROM bins GROUP BY 1, 2, 3
""")
def status_band_counts(spark, sf_dir):
    """A1 -> P18: number of 10-minute bins per zone and status band."""
    b = bin_mean(readings_from_events(spark, sf_dir))
    return (b.groupBy("zone", status_band("rvr").alias("status"), status_color("rvr").alias("color"))
            .agg(F.count(F.lit(1)).alias("n_bins"), r4(F.avg("rvr")).alias("avg_rvr")))


@register("valid_readings", with_(READINGS) + """
SELECT ts, zone, round(rvr, 4) AS rvr,
  coalesce(rvr > 0 AND rvr < 3333.0, false) AS valid,
  round(CASE WHEN rvr IS NULL OR rvr = 3333.0 THEN 1000.0 ELSE rvr END, 4) AS current
FROM readings
""")
def valid_readings(spark, sf_dir):
    """P11 + P12: valid-reading flag and the 'current' value of every reading."""
    r = readings_from_events(spark, sf_dir)
    return r.select("ts", "zone", r4("rvr").alias("rvr"), is_valid("rvr").alias("valid"),
                    r4(current_value("rvr")).alias("current"))


@register("pivot_zones", with_(BINS) + """
SELECT ts,
  max(CASE WHEN zone = 'click' THEN round(rvr, 4) END) AS click,
  max(CASE WHEN zone = 'error' THEN round(rvr, 4) END) AS error,
  max(CASE WHEN zone = 'purchase' THEN round(rvr, 4) END) AS purchase,
  max(CASE WHEN zone = 'signup' THEN round(rvr, 4) END) AS signup,
  max(CASE WHEN zone = 'view' THEN round(rvr, 4) END) AS "view"
FROM bins GROUP BY ts
""")
def pivot_zones_q(spark, sf_dir):
    """A2: long bins -> wide, one column per zone (zone list from the data)."""
    b = bin_mean(readings_from_events(spark, sf_dir)).withColumn("rvr", r4("rvr"))
    return pivot_zones(b, None)


@register("parse_log_roundtrip", with_(READINGS) + """
SELECT date_trunc('second', ts) AS ts, upper(zone) AS zone, CAST(floor(rvr) AS DOUBLE) AS rvr FROM readings
UNION ALL
SELECT date_trunc('second', ts) AS ts, 'RWY ' || upper(zone) AS zone, CAST(NULL AS DOUBLE) AS rvr FROM readings
""")
def parse_log_roundtrip(spark, sf_dir):
    """S2 + P4: raw log lines are parsed back into (ts, zone, value).

    The lines are rendered from the readings (date, time, one part with an
    integer value and one part '<runway> -' with a missing value); the
    parser does all the work: shape check, date parse, tab split, strip,
    last-blank split, integer coercion and zone normalisation.
    """
    r = readings_from_events(spark, sf_dir)
    line = F.concat_ws("\t", F.date_format("ts", "dd-MM-yyyy"), F.date_format("ts", "HH:mm:ss"),
                       F.concat(F.col("zone"), F.lit(" "), F.floor("rvr").cast("bigint").cast("string")),
                       F.concat(F.lit("runway "), F.col("zone"), F.lit(" -")))
    parsed = parse_log_lines(r.select(line.alias("value")))
    return parsed.select("ts", "zone", "rvr")


@register("multi_format_ts", """
WITH t AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
    CASE event_id % 3 WHEN 0 THEN strftime(CAST(ts AS TIMESTAMP), '%d/%m/%Y %H:%M')
                      WHEN 1 THEN strftime(CAST(ts AS TIMESTAMP), '%m/%d/%Y %H:%M')
                      ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS txt
  FROM events
)
SELECT event_id, txt,
  coalesce(try_strptime(txt, '%d/%m/%Y %H:%M'), try_strptime(txt, '%m/%d/%Y %H:%M'),
           try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y-%m-%d %H:%M')) AS parsed
FROM t
""")
def multi_format_ts(spark, sf_dir):
    """Row-level multi-format timestamp parse (first format that parses wins).

    Text is rendered per row in one of three formats; ambiguous day/month
    values resolve to the first format, as the rule says.
    """
    e = table(spark, sf_dir, "events")
    fmt = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm"))
           .when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy HH:mm"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    t = e.select("event_id", fmt.alias("txt"))
    return t.select("event_id", "txt", parse_ts("txt").alias("parsed"))


@register("normalize_runway", """
WITH n AS (
  SELECT CASE event_id % 4 WHEN 0 THEN 'Runway-' WHEN 1 THEN 'runway ' WHEN 2 THEN 'RWY ' ELSE ' Rwy' END
         || lpad(CAST(user_id % 32 AS VARCHAR), 2, '0') || ' (' || upper(substr(event_type, 1, 3)) || ') ' AS name
  FROM events
), o AS (
  SELECT name,
    trim(replace(upper(name), 'RUNWAY', 'RWY')) AS log_zone,
    CASE WHEN contains(replace(upper(name), '-', ''), 'RUNWAY28') THEN 'RUNWAY28'
         WHEN contains(replace(upper(name), '-', ''), 'RUNWAY29') THEN 'RUNWAY29'
         WHEN contains(replace(upper(name), '-', ''), 'RUNWAY11') THEN 'RUNWAY11'
         ELSE name END AS weather_runway
  FROM n
)
SELECT name, log_zone, weather_runway,
  regexp_replace(replace(log_zone, ' ', '_'), '[()]', '', 'g') AS safe_id,
  count(*) AS n
FROM o GROUP BY 1, 2, 3, 4
""")
def normalize_runway(spark, sf_dir):
    """Log zone normalisation, weather runway folding, safe zone id."""
    e = table(spark, sf_dir, "events")
    prefix = (F.when(F.col("event_id") % 4 == 0, F.lit("Runway-")).when(F.col("event_id") % 4 == 1, F.lit("runway "))
              .when(F.col("event_id") % 4 == 2, F.lit("RWY ")).otherwise(F.lit(" Rwy")))
    name = F.concat(prefix, F.lpad((F.col("user_id") % 32).cast("string"), 2, "0"), F.lit(" ("),
                    F.upper(F.substring("event_type", 1, 3)), F.lit(") "))
    n = e.select(name.alias("name"))
    o = n.select("name", normalize_log_zone("name").alias("log_zone"),
                 normalize_weather_runway("name").alias("weather_runway"))
    return (o.withColumn("safe_id", safe_zone("log_zone"))
            .groupBy("name", "log_zone", "weather_runway", "safe_id").agg(F.count(F.lit(1)).alias("n")))


@register("zone_id_roundtrip", with_(READINGS) + """
SELECT 'RWY ' || lpad(CAST(length(zone) AS VARCHAR), 2, '0') || ' (' || upper(substr(zone, 1, 3)) || ')' AS zone_name,
       'RWY_' || lpad(CAST(length(zone) AS VARCHAR), 2, '0') || '_' || upper(substr(zone, 1, 3)) AS zone_id,
       count(*) AS n
FROM readings GROUP BY 1, 2
""")
def zone_id_roundtrip(spark, sf_dir):
    """Zone name -> safe id -> zone name, checked to round-trip."""
    r = readings_from_events(spark, sf_dir)
    name = F.concat(F.lit("RWY "), F.lpad(F.length("zone").cast("string"), 2, "0"), F.lit(" ("),
                    F.upper(F.substring("zone", 1, 3)), F.lit(")"))
    z = r.select(name.alias("zone_name")).withColumn("zone_id", safe_zone("zone_name"))
    z = z.filter(zone_from_safe("zone_id") == F.col("zone_name"))
    return z.groupBy("zone_name", "zone_id").agg(F.count(F.lit(1)).alias("n"))
