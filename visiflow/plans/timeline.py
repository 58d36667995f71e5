"""Prediction timeline for maps: proxy zones, positions, bands, JSON features.

Dimensions (runways, zone proxies) are fixed small tables, so they are
broadcast; the fact side (predictions per time and zone) streams through
map-side joins and expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.geo import destination
from visiflow.functions.times import format_ts
from visiflow.functions.values import default_fill, status_band, status_color
from visiflow.operators.state import horizon


def runway_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.RUNWAYS, "runway string, lat double, lon double, heading double, length_m int")


def zone_points(spark: SparkSession) -> DataFrame:
    """TDZ (fixed distance) and MID (half length) point of every runway, by great-circle math."""
    r = runway_dim(spark)
    tdz_lat, tdz_lon = destination("lat", "lon", "heading", F.lit(C.TDZ_DISTANCE_M))
    mid_lat, mid_lon = destination("lat", "lon", "heading", F.col("length_m") / 2.0)
    tdz = r.select(F.concat(F.lit("RWY_"), "runway", F.lit("_TDZ")).alias("display_zone"),
                   tdz_lat.alias("lat"), tdz_lon.alias("lon"))
    mid = r.select(F.concat(F.lit("RWY_"), "runway", F.lit("_MID")).alias("display_zone"),
                   mid_lat.alias("lat"), mid_lon.alias("lon"))
    return tdz.unionByName(mid)


def timeline_rows(predictions: DataFrame, spark: SparkSession, hours: int | None = C.HORIZON_HOURS,
                  value: str = "value", zone_id: str = "zone_id") -> DataFrame:
    """One row per (time, display zone): proxied value (default 1000), band, colour, position.

    ``predictions`` is long: (ts, zone_id, value).  Times come from the
    predictions; a display zone whose source zone has no value at a time
    gets the default.  Every time expands to the 12 display zones with an
    ``explode`` of the fixed proxy list (a generator, no join), then the
    values are attached by an equi-join on (time, source zone).
    """
    p = horizon(predictions, hours) if hours else predictions
    proxies = F.array(*[F.struct(F.lit(d).alias("display_zone"), F.lit(src).alias("source_zone"))
                        for d, src in C.ZONE_PROXY])
    grid = p.select("ts").distinct().select("ts", F.explode(proxies).alias("_z")).select("ts", "_z.*")
    vals = p.select("ts", F.col(zone_id).alias("source_zone"), F.col(value).alias("_v"))
    j = (grid.join(vals, ["ts", "source_zone"], "left")
         .join(F.broadcast(zone_points(spark)), "display_zone"))       # fixed 12-row dimension
    v = default_fill("_v")
    return j.select("ts", format_ts("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "display_zone", "source_zone",
                    F.round(v, 1).alias("rvr_value"), status_band(v).alias("status"), status_color(v).alias("color"),
                    "lat", "lon")


def timeline_features(rows: DataFrame) -> DataFrame:
    """GeoJSON-like feature per row, serialised with to_json (one feature per line on the sink)."""
    feat = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("time"), F.col("display_zone").alias("zone"), F.col("rvr_value"), F.col("status"),
                 F.col("color"),
                 F.struct(F.col("color").alias("fillColor"), F.lit("black").alias("color"), F.lit(2).alias("weight"),
                          F.lit(0.7).alias("fillOpacity"), F.lit(12).alias("radius")).alias("style"))
        .alias("properties"))
    return rows.select("ts", "display_zone", F.to_json(feat).alias("feature"))


def write_timeline(features: DataFrame, path: str) -> None:
    """One JSON feature per line, partitioned by day."""
    (features.withColumn("day", F.to_date("ts")).select("day", "feature").write.mode("overwrite")
     .partitionBy("day").text(path))
