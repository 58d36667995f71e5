"""Latest-state reports: newest row per key, readiness, profiles, status counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.values import is_valid


def latest_per_key(df: DataFrame, keys: Sequence[str] = ("zone",), order: str = "ts",
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Newest row per key by time, as one partial hash aggregation (no sort of the rows).

    One ``max_by`` per column, all by the same time, so every column comes from
    the same row; of rows that share key and time any one is taken.
    """
    keys = list(keys)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys + [order]]
    return df.filter(F.col(order).isNotNull()).groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(F.col(c), F.col(order)).alias(c) for c in cols])


def tail_positions(cells: DataFrame, n: int = C.TAIL_ROWS, ts: str = "ts") -> DataFrame:
    """The newest ``n`` distinct times (every task keeps its own n, then one merge)."""
    return cells.select(ts).distinct().orderBy(F.col(ts).desc()).limit(n)


def last_valid_in_tail(cells: DataFrame, n: int = C.TAIL_ROWS, value: str = "rvr",
                       keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Newest valid value per zone among the newest ``n`` grid rows, with its own time."""
    tail = tail_positions(cells, n)
    rows = cells.join(tail, "ts", "left_semi").filter(is_valid(F.col(value)))
    return latest_per_key(rows.select(*keys, "ts", value), keys)


def readiness(readings: DataFrame, value: str = "rvr", keys: Sequence[str] = ("zone",),
              depth: int = C.STATE_DEPTH) -> DataFrame:
    """Per zone: valid points held (at most depth), required, can_predict, latest value and time."""
    v = readings.filter(is_valid(F.col(value)))
    agg = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                               F.max_by(F.col(value), F.col("ts")).alias("latest_value"),
                               F.max("ts").alias("latest_ts"))
    return agg.select(*keys, F.least(F.col("_n"), F.lit(depth)).cast("bigint").alias("data_points"),
                      F.lit(depth).cast("bigint").alias("required"),
                      (F.col("_n") >= depth).alias("can_predict"), "latest_value", "latest_ts")


def profile(df: DataFrame, ts: str = "ts", cols: Sequence[str] | None = None) -> DataFrame:
    """One row: row count, first/last time and the non-null count of every column (one pass)."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c != ts]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                  *[F.count(F.col(f"`{c}`")).alias(f"nonnull_{c}") for c in cols])


def horizon(df: DataFrame, hours: int = C.HORIZON_HOURS, ts: str = "ts") -> DataFrame:
    """Rows with time in [min(ts), min(ts) + hours] (both ends inclusive).

    The start is a scalar subquery (one value, computed once), so the filter
    runs map-side with no join.  The window always holds the row at min(ts).
    """
    start = df.select(F.min(ts)).scalar()
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= F.timestamp_add("HOUR", F.lit(hours), start)))


def min_sample_gate(df: DataFrame, keys: Sequence[str] = ("zone",), minimum: int = C.MIN_SAMPLES) -> DataFrame:
    """Rows of keys holding at least ``minimum`` rows (count per key, then a semi join)."""
    keys = list(keys)
    ok = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select(*keys)
    return df.join(ok, keys, "left_semi")


def column_samples(df: DataFrame, cols: Sequence[str], n: int = 5, order: str = "ts") -> DataFrame:
    """The first ``n`` non-null values of every column in time order (column, ts, value).

    One pass over the input for all columns: a group-limited row number, of
    which every task keeps its own n rows per column before the shuffle.
    """
    long = (df.select(order, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
            .unpivot([order], list(cols), "column", "value").filter(F.col("value").isNotNull()))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(order, "value"))
    return long.withColumn("_r", rank).filter(F.col("_r") <= n).select("column", order, "value")
