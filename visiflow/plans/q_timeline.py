"""Timeline queries: proxied map rows with positions and bands, JSON features."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.geo import EARTH_RADIUS_M
from visiflow.functions.names import part_of_zone, runway_of_zone
from visiflow.functions.times import floor_minutes
from visiflow.plans.catalog import register
from visiflow.plans.timeline import timeline_features, timeline_rows, write_timeline
from visiflow.session import ensure_checkpoint_dir
from visiflow.sources.readings import table
from visiflow.streaming.jobs import run_dir

ZONE_IDS = [z.replace(" ", "_").replace("(", "").replace(")", "") for z in C.ZONES]


def predictions_from_events(spark, sf_dir):
    """Stand-in long prediction table (ts, zone_id, value) in the schema the map expects.

    Events are assigned to the 11 sensor zone ids by ``user_id % 11`` and
    averaged per 10-minute bin.
    """
    e = table(spark, sf_dir, "events")
    zid = F.element_at(F.array(*[F.lit(z) for z in ZONE_IDS]), (F.col("user_id") % 11 + 1).cast("int"))
    return (e.select(floor_minutes(F.col("ts")).alias("ts"), zid.alias("zone_id"), (F.col("value") * 10.0).alias("v"))
            .groupBy("ts", "zone_id").agg(F.round(F.avg("v"), 4).alias("value")))


def _pts_sql(dist_expr: str, suffix: str) -> str:
    d = f"(({dist_expr}) / {EARTH_RADIUS_M})"
    s2 = f"(sin(radians(lat)) * cos({d}) + cos(radians(lat)) * sin({d}) * cos(radians(heading)))"
    return (f"SELECT 'RWY_' || runway || '_{suffix}' AS display_zone, degrees(asin({s2})) AS lat, "
            f"degrees(radians(lon) + atan2(sin(radians(heading)) * sin({d}) * cos(radians(lat)), "
            f"cos({d}) - sin(radians(lat)) * {s2})) AS lon FROM rw")


TIMELINE_SQL = f"""
WITH p AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) AS ts,
         list_value({", ".join(f"'{z}'" for z in ZONE_IDS)})[user_id % 11 + 1] AS zone_id, round(avg(value * 10.0), 4) AS value
  FROM events GROUP BY 1, 2
),
h AS (SELECT * FROM p WHERE ts >= (SELECT min(ts) FROM p) AND ts <= (SELECT min(ts) FROM p) + INTERVAL 12 HOUR),
proxy(display_zone, source_zone) AS (VALUES {", ".join(f"('{d}', '{s}')" for d, s in C.ZONE_PROXY)}),
rw(runway, lat, lon, heading, length_m) AS (VALUES {", ".join(f"('{r}', {la!r}, {lo!r}, {hd!r}, {ln})" for r, la, lo, hd, ln in C.RUNWAYS)}),
pts AS ({_pts_sql(repr(C.TDZ_DISTANCE_M), "TDZ")} UNION ALL {_pts_sql("length_m / 2.0", "MID")}),
g AS (SELECT t.ts, proxy.display_zone, proxy.source_zone FROM (SELECT DISTINCT ts FROM h) t CROSS JOIN proxy),
v AS (SELECT g.*, coalesce(h.value, 1000.0) AS val FROM g LEFT JOIN h ON h.ts = g.ts AND h.zone_id = g.source_zone)
SELECT v.ts, strftime(v.ts, '%Y-%m-%dT%H:%M:%S') AS time, v.display_zone, v.source_zone, CAST(round(CAST(val AS DECIMAL(18, 4)), 1) AS DOUBLE) AS rvr_value,
  CASE WHEN val >= 800 THEN 'Good' WHEN val >= 500 THEN 'Moderate' WHEN val >= 200 THEN 'Poor' ELSE 'Very Poor' END AS status,
  CASE WHEN val >= 800 THEN 'green' WHEN val >= 500 THEN 'orange' WHEN val >= 200 THEN 'red' ELSE 'darkred' END AS color,
  round(pts.lat, 6) AS lat, round(pts.lon, 6) AS lon
FROM v JOIN pts USING (display_zone)
"""


@register("timeline_rows", TIMELINE_SQL)
def timeline_rows_q(spark, sf_dir):
    """P14 + P19 + P20 + P18 + F6 + J5 + F7: map rows for the first 12 hours, one per time and display zone."""
    rows = timeline_rows(predictions_from_events(spark, sf_dir), spark, 12)
    return rows.select("ts", "time", "display_zone", "source_zone", "rvr_value", "status", "color",
                       F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@register("timeline_json", TIMELINE_SQL.replace("h AS (SELECT * FROM p WHERE ts >= (SELECT min(ts) FROM p) AND ts <= (SELECT min(ts) FROM p) + INTERVAL 12 HOUR)",
                                                "h AS (SELECT * FROM p)")
          .replace("SELECT v.ts, strftime", "SELECT 'Feature' AS type, 'Point' AS geometry, strftime").replace("v.source_zone, ", ""))
def timeline_json_q(spark, sf_dir):
    """F9 + S15: GeoJSON-like features over the whole prediction table, written one a line and read back."""
    ensure_checkpoint_dir(spark)
    out = run_dir(spark, "timeline")
    rows = timeline_rows(predictions_from_events(spark, sf_dir), spark, None)
    write_timeline(timeline_features(rows), out)
    kind = ("type string, geometry struct<type: string, coordinates: array<double>>, "
            "properties struct<time: string, zone: string, rvr_value: double, status: string, color: string>")
    f = spark.read.text(out).select(F.from_json("value", kind).alias("f")).select("f.*")
    p = F.col("properties")
    return f.select("type", F.col("geometry.type").alias("geometry"), p.time.alias("time"), p.zone.alias("display_zone"),
                    p.rvr_value.alias("rvr_value"), p.status.alias("status"), p.color.alias("color"),
                    F.round(F.col("geometry.coordinates")[1], 6).alias("lat"), F.round(F.col("geometry.coordinates")[0], 6).alias("lon"))


@register("zone_parts", f"""
WITH p AS (
  SELECT list_value({", ".join(f"'{z}'" for z in ZONE_IDS)})[user_id % 11 + 1] AS zone_id FROM events
)
SELECT regexp_extract(zone_id, 'RWY[ _]?([0-9]{{2}})', 1) AS runway, regexp_extract(zone_id, '(BEG|TDZ|MID)', 1) AS part,
  CAST(regexp_extract(zone_id, '(BEG|TDZ|MID)', 1) = 'BEG' AS INTEGER) AS is_beg,
  CAST(regexp_extract(zone_id, '(BEG|TDZ|MID)', 1) = 'TDZ' AS INTEGER) AS is_tdz,
  CAST(regexp_extract(zone_id, '(BEG|TDZ|MID)', 1) = 'MID' AS INTEGER) AS is_mid, count(*) AS n
FROM p GROUP BY 1, 2, 3, 4, 5
""")
def zone_parts(spark, sf_dir):
    """Runway number and zone part (BEG / TDZ / MID) of each prediction's zone id, one-hot, counted."""
    e = table(spark, sf_dir, "events")
    zid = F.element_at(F.array(*[F.lit(z) for z in ZONE_IDS]), (F.col("user_id") % 11 + 1).cast("int"))
    z = e.select(zid.alias("zone_id"))
    part = part_of_zone("zone_id")
    out = z.select(runway_of_zone("zone_id").alias("runway"), part.alias("part"),
                   *[(part == F.lit(x)).cast("int").alias(f"is_{x.lower()}") for x in ("BEG", "TDZ", "MID")])
    return out.groupBy("runway", "part", "is_beg", "is_tdz", "is_mid").agg(F.count(F.lit(1)).alias("n"))
