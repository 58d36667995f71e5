"""Cleaning jobs: raw logs -> yearly 10-minute tables; raw weather -> runway-year tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.names import normalize_weather_runway
from visiflow.operators.binning import bin_mean, pivot_zones, resample_per_source
from visiflow.operators.joins import feed_join
from visiflow.sources.readings import scan_logs
from visiflow.sources.sinks import write_runway_year, write_yearly


def clean_logs(spark: SparkSession, root: str, out: str | None = None, zones: list[str] | None = None,
               sentinel: str = "keep") -> DataFrame:
    """S1 -> S2 -> P4 -> A1 (-> A2 -> S8): raw sensor logs to 10-minute means per zone.

    Returns the long bins (ts, zone, rvr, year); with ``out`` also writes the
    wide table (one column per zone) partitioned by year.
    """
    readings = scan_logs(spark, root)
    bins = bin_mean(readings, sentinel=sentinel).select("ts", "zone", "rvr")
    if out:
        wide = pivot_zones(bins, zones)
        write_yearly(wide, out)
    return bins.withColumn("year", F.year("ts"))


def start_from(df: DataFrame, col: str, start: str) -> DataFrame:
    """Rows whose ``col`` sorts at or after ``start`` — only if ``start`` itself occurs.

    The existence test is an EXISTS subquery (one boolean), so no join runs.
    """
    exists = df.filter(F.col(col) == F.lit(start)).exists()
    return df.filter((F.col(col) >= F.lit(start)) & exists)


def required_columns_missing(df: DataFrame, required=C.WEATHER_CANONICAL) -> list[str]:
    """Required columns that the frame does not have (schema only)."""
    return [c for c in required if c not in df.columns]


def project_final(df: DataFrame, required=C.WEATHER_CANONICAL, keys=("ts", "runway")) -> DataFrame:
    """Keep the final columns that exist, in the required order."""
    return df.select(*keys, *[c for c in required if c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns (schema only)."""
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def clean_weather(para: DataFrame, wind: DataFrame, out: str | None = None, per_file: bool = False) -> DataFrame:
    """S4 -> P5 -> A3 -> J1 -> P9 (-> S9): two weather feeds to one 10-minute table per runway.

    Both feeds carry ``ts``, ``runway`` and measures (and ``source_file``
    when ``per_file``).  Each is averaged per 10-minute bin; the two are
    inner-joined on (runway, ts) and projected to the final columns.
    """
    def prep(df):
        df = df.withColumn("runway", normalize_weather_runway("runway"))
        measures = [c for c in numeric_columns(df) if c not in ("year",)]
        return resample_per_source(df, measures, keys=["runway"], per_source=per_file)

    p, w = prep(para), prep(wind)
    # of a measure that both feeds deliver, the first feed's (para) is the final column
    w = w.drop(*[c for c in C.WEATHER_CANONICAL if c in p.columns and c in w.columns])
    j = feed_join(p, w, ["runway", "ts"])
    final = project_final(j, keys=("ts", "runway", *[c for c in j.columns if c.startswith("source_file")]))
    if out:
        write_runway_year(final, out)
    return final
