"""Sinks: partitioned tables, prediction history / latest, training log, batch ranges.

All writes are Spark writes (parallel, one file set per task), sorted by time
inside each file; nothing is assembled on the driver.  Paths should live on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.operators.state import latest_per_key


def write_yearly(df: DataFrame, path: str, fmt: str = "parquet", ts: str = "ts") -> None:
    """One partition per year."""
    (df.withColumn("year", F.year(ts)).sortWithinPartitions("year", ts).write.mode("overwrite").partitionBy("year").format(fmt)
     .option("header", "true").save(path))


def write_runway_year(df: DataFrame, path: str, fmt: str = "parquet", ts: str = "ts") -> None:
    """One partition per (runway, year)."""
    (df.withColumn("year", F.year(ts)).sortWithinPartitions("runway", "year", ts)
     .write.mode("overwrite").partitionBy("runway", "year").format(fmt)
     .option("header", "true").save(path))


def append_history(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append predictions partitioned by run date (no read-modify-write of old files)."""
    (df.withColumn("run_date", F.to_date(ts)).sortWithinPartitions("run_date", ts)
     .write.mode("append").partitionBy("run_date").parquet(path))


def write_latest(df: DataFrame, path: str, keys=("zone",), ts: str = "ts", mode: str = "latest") -> None:
    """Replace the 'latest' table: newest row per key (``mode='copy'`` writes the whole input)."""
    if mode == "copy":
        df.write.mode("overwrite").parquet(path)
        return
    latest_per_key(df, keys, ts).select(*df.columns).write.mode("overwrite").parquet(path)


def write_range(df: DataFrame, path: str, ts: str = "ts", fmt: str = C.OUTPUT_TS_FORMAT) -> None:
    """Batch-range predictions with time formatted as text, CSV with header."""
    out = df.sortWithinPartitions(ts).withColumn(ts, F.date_format(ts, fmt))
    out.write.mode("overwrite").option("header", "true").csv(path)


def append_training_log(log: DataFrame, path: str) -> None:
    """Append the run log (partitioned by zone)."""
    log.write.mode("append").partitionBy("zone").parquet(path)
