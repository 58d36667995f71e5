"""File round-trip queries: raw logs, wide CSV and weather files written from the
test tables, then read back through the library's scans and cleaning jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.operators.binning import bin_mean, pivot_zones
from visiflow.plans.catalog import register
from visiflow.plans.cleaning import clean_logs, clean_weather, required_columns_missing
from visiflow.plans.sql import BINS, READINGS, with_
from visiflow.session import ensure_checkpoint_dir
from visiflow.sources.readings import newest_file, read_weather, read_wide_csv, readings_from_events, table
from visiflow.streaming.jobs import run_dir


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def _years(df, ts="ts"):
    """Distinct years (a tiny dimension) for one output folder per year."""
    return sorted(r["y"] for r in df.select(F.year(ts).alias("y")).distinct().collect())


@register("log_files_to_bins", with_(READINGS) + """
SELECT time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts)) AS ts, upper(zone) AS zone,
       round(avg(floor(rvr)), 4) AS rvr, CAST(year(ts) AS BIGINT) AS year
FROM readings GROUP BY 1, 2, 4
""")
def log_files_to_bins(spark, sf_dir):
    """S1 + S2 + P4 + A1 + A2 + S8: raw text logs under <root>/<year>/ -> 10-minute means per zone.

    Lines are rendered from the readings into one folder per year; the
    cleaning job scans every .txt below the all-digit year folders, parses,
    bins, writes the wide yearly table, and the long bins are returned.
    """
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "logs")
    r = readings_from_events(spark, sf_dir)
    line = F.concat_ws("\t", F.date_format("ts", "dd-MM-yyyy"), F.date_format("ts", "HH:mm:ss"),
                       F.concat(F.col("zone"), F.lit(" "), F.floor("rvr").cast("bigint").cast("string")),
                       F.concat(F.lit("runway "), F.col("zone"), F.lit(" -")))
    lines = r.select(line.alias("value"), F.year("ts").alias("y"))
    for y in _years(r):
        lines.filter(F.col("y") == y).select("value").write.mode("overwrite").text(f"{base}/raw/{y}/part")
    bins = clean_logs(spark, f"{base}/raw", f"{base}/wide")
    return bins.filter(F.col("rvr").isNotNull()).select("ts", "zone", r4("rvr").alias("rvr"),
                                                        F.col("year").cast("bigint").alias("year"))


@register("wide_csv_roundtrip", with_(BINS) + """
SELECT ts, zone, round(rvr, 4) AS rvr FROM bins
""")
def wide_csv_roundtrip(spark, sf_dir):
    """S3 + P1 + P7 + U1: wide CSV files with different zone columns, unioned by name, back to long.

    Two files carry disjoint zone columns; times are written as
    dd/MM/yyyy HH:mm text and parsed by the multi-format rule.
    """
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "csv")
    b = bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")
    zones = sorted(r["zone"] for r in b.select("zone").distinct().collect())
    half = len(zones) // 2 or 1
    paths = []
    for i, part in enumerate([zones[:half], zones[half:]]):
        w = pivot_zones(b.filter(F.col("zone").isin(part)), part)
        w = w.select(F.date_format("ts", "dd/MM/yyyy HH:mm").alias("Datetime"),
                     *[F.col(z).cast("string").alias(z) for z in part])
        p = f"{base}/RVR_{i}"
        w.write.mode("overwrite").option("header", "true").csv(p)
        paths.append(p)
    long = read_wide_csv(spark, paths, "Datetime")
    return long.filter(F.col("rvr").isNotNull()).select("ts", "zone", r4("rvr").alias("rvr"))


#: Raw runway names of the stand-in files; a zone that is not listed reports for the last one.
RUNWAY_OF_ZONE = {"click": "RUNWAY-11", "error": "RUNWAY-28", "purchase": "RUNWAY-29", "signup": "RUNWAY-28L"}
OTHER_RUNWAY = "RUNWAY10"


def _weather_files(spark, sf_dir, base):
    """Raw weather files of both feeds, one folder a runway name."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    raw = e.select(F.date_format("ts", "dd/MM/yyyy").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"),
                   "event_type", "user_id", F.col("value"), k.alias("k"))
    name = F.coalesce(*[F.when(F.col("event_type") == z, rw) for z, rw in RUNWAY_OF_ZONE.items()], F.lit(OTHER_RUNWAY))
    raw = raw.withColumn("rw", name)
    names = dict(zip(C.WEATHER_CANONICAL, C.WEATHER_COLUMNS[2:]))
    for rw in [*RUNWAY_OF_ZONE.values(), OTHER_RUNWAY]:
        z = raw.filter(F.col("rw") == rw)
        (z.filter(F.col("user_id") % 2 == 0)
         .select("Date", "Time", F.col("value").alias(names["temperature"]), F.col("k").alias(names["humidity"]))
         .write.mode("overwrite").option("header", "true").csv(f"{base}/para/{rw}_2024"))
        (z.filter(F.col("user_id") % 2 == 1)
         .select("Date", "Time", F.col("value").alias(names["wind_speed"]), (F.col("k") * 3.6).alias(names["wind_dir"]))
         .write.mode("overwrite").option("header", "true").csv(f"{base}/wind/{rw}_2024"))


@register("weather_clean", """
WITH base AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts,
    CASE event_type WHEN 'click' THEN 'RUNWAY11' WHEN 'error' THEN 'RUNWAY28' WHEN 'purchase' THEN 'RUNWAY29'
                    WHEN 'signup' THEN 'RUNWAY28' ELSE 'RUNWAY10' END AS runway,
    user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
),
para AS (SELECT time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts)) AS ts, runway,
                avg(value) AS temperature, avg(k) AS humidity FROM base WHERE user_id % 2 = 0 GROUP BY 1, 2),
wind AS (SELECT time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts)) AS ts, runway,
                avg(value) AS wind_speed, avg(k * 3.6) AS wind_dir FROM base WHERE user_id % 2 = 1 GROUP BY 1, 2)
SELECT p.ts, p.runway, round(temperature, 4) AS temperature, round(humidity, 4) AS humidity,
       round(wind_speed, 4) AS wind_speed, round(wind_dir, 4) AS wind_dir, CAST(year(p.ts) AS BIGINT) AS year
FROM para p JOIN wind w ON p.runway = w.runway AND p.ts = w.ts
""")
def weather_clean(spark, sf_dir):
    """S4 + P2 + P5 + A3 + J1 + P9 + S9: weather files per runway and feed -> one 10-minute table.

    Raw files carry Date / Time text columns and the delivered measure
    names; the runway comes from the folder name and is folded by the
    weather rule (RUNWAY-28L -> RUNWAY28).  Output is written per (runway,
    year) and read back.
    """
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "weather")
    _weather_files(spark, sf_dir, base)
    para = read_weather(spark, f"{base}/para")
    wind = read_weather(spark, f"{base}/wind")
    clean_weather(para, wind, out=f"{base}/clean")
    out = spark.read.parquet(f"{base}/clean")
    return out.select("ts", "runway", r4("temperature").alias("temperature"), r4("humidity").alias("humidity"),
                      r4("wind_speed").alias("wind_speed"), r4("wind_dir").alias("wind_dir"),
                      F.col("year").cast("bigint").alias("year"))


WEATHER_ROWS = """
WITH base AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts,
    CASE event_type WHEN 'click' THEN 'RUNWAY11' WHEN 'error' THEN 'RUNWAY28' WHEN 'purchase' THEN 'RUNWAY29'
                    WHEN 'signup' THEN 'RUNWAY28' ELSE 'RUNWAY10' END AS runway, user_id FROM events
),
b AS (SELECT DISTINCT time_bucket(INTERVAL 10 MINUTE, date_trunc('second', ts)) AS ts, runway, user_id % 2 AS feed FROM base),
j AS (SELECT p.ts, p.runway FROM b p JOIN b w ON p.runway = w.runway AND p.ts = w.ts AND p.feed = 0 AND w.feed = 1)"""


@register("weather_listing", WEATHER_ROWS + """
SELECT row_number() OVER (ORDER BY runway, year(ts)) AS place, runway, CAST(year(ts) AS BIGINT) AS year, count(*) AS n FROM j GROUP BY runway, year(ts)
""")
def weather_listing(spark, sf_dir):
    """O4 + S9: the runway-years of the cleaned weather, in order, with their rows."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "weather-listing")
    _weather_files(spark, sf_dir, base)
    clean_weather(read_weather(spark, f"{base}/para"), read_weather(spark, f"{base}/wind"), out=f"{base}/clean")
    counts = spark.read.parquet(f"{base}/clean").groupBy("runway", F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy("runway", "year"))      # one row a runway-year
    return counts.select(place.cast("bigint").alias("place"), "runway", "year", "n")


@register("weather_columns", WEATHER_ROWS + """
SELECT c AS name, c IN ('temperature', 'humidity', 'wind_dir', 'wind_speed') AS present,
  CASE WHEN c IN ('temperature', 'humidity', 'wind_dir', 'wind_speed') THEN (SELECT count(*) FROM j) ELSE 0 END AS n_values
FROM (VALUES ('temperature'), ('dew_point'), ('humidity'), ('pressure'), ('qnh'), ('qfe'), ('wind_dir'), ('wind_speed')) s(c)
""")
def weather_columns(spark, sf_dir):
    """P9 + U2: the final weather columns, which of them the feeds lack, and the values of those present."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "weather-columns")
    _weather_files(spark, sf_dir, base)
    final = clean_weather(read_weather(spark, f"{base}/para"), read_weather(spark, f"{base}/wind"))
    missing = set(required_columns_missing(final))
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c not in missing).alias("present"),
                              (F.lit(0) if c in missing else F.count(c)).cast("bigint").alias("n_values")) for c in C.WEATHER_CANONICAL])
    return final.agg(each.alias("c")).select(F.inline("c"))


@register("newest_file_pick", with_(BINS) + "SELECT zone, count(*) AS n, round(sum(rvr), 4) AS total FROM bins GROUP BY zone")
def newest_file_pick(spark, sf_dir):
    """Of the prediction files in two search folders the one written last is read (the first holds half the bins)."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "newest")
    bins = bin_mean(readings_from_events(spark, sf_dir)).select("ts", "zone", "rvr")
    bins.filter(F.hour("ts") < 12).coalesce(1).write.parquet(f"{base}/b-first")
    bins.coalesce(1).write.parquet(f"{base}/a-last")
    newest = spark.read.parquet(newest_file(spark, base, "*.parquet"))
    return newest.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("rvr")).alias("total"))
