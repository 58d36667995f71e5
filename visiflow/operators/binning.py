"""Fixed-interval binning (tumbling windows) and zone pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.times import floor_minutes


def bin_mean(readings: DataFrame, minutes: int = C.BIN_MINUTES, keys: Sequence[str] = ("zone",),
             value: str = "rvr", sentinel: str = "keep", sentinel_value: float = C.SENTINEL_RVR) -> DataFrame:
    """Mean per (bin start, keys); null readings go first, so a bin of only nulls does not exist.

    ``sentinel='keep'`` averages off-scale sentinels with real readings (the
    source system's behaviour); ``'drop'`` treats them as missing (such a bin
    keeps its row, with a NULL mean and its sentinel share).  Also returns the
    number of readings and the share that were the sentinel.

    Plan: partial aggregation per map task, one shuffle on (bin, keys); a hot
    key is combined map-side before the shuffle.
    """
    v = F.col(value)
    is_sent = v == F.lit(sentinel_value)
    if sentinel == "drop":
        v = F.when(is_sent, F.lit(None).cast("double")).otherwise(v)
    return (readings.filter(F.col(value).isNotNull())
            .groupBy(floor_minutes("ts", minutes).alias("ts"), *keys)
            .agg(F.avg(v).alias(value),
                 F.count(F.col(value)).alias("n_readings"),
                 (F.sum(F.when(is_sent, 1).otherwise(0)) / F.count(F.lit(1))).alias("sentinel_share")))


def pivot_zones(bins: DataFrame, zones: Sequence[str] | None, value: str = "rvr", ts: str = "ts") -> DataFrame:
    """Long bins -> wide (ts + one column per zone).

    With an explicit zone list no extra job runs; without one Spark finds the
    distinct zones first (bounded by ``spark.sql.pivotMaxValues``).
    """
    g = bins.groupBy(ts)
    g = g.pivot("zone", list(zones)) if zones is not None else g.pivot("zone")
    return g.agg(F.first(value))


def resample_per_source(df: DataFrame, measures: Sequence[str], source: str = "source_file",
                        keys: Sequence[str] = (), minutes: int = C.BIN_MINUTES,
                        per_source: bool = True) -> DataFrame:
    """Mean of every measure per bin (and per source file when ``per_source``).

    Bins where every measure is NULL are dropped.
    """
    group = [floor_minutes("ts", minutes).alias("ts"), *keys] + ([source] if per_source else [])
    out = df.groupBy(*group).agg(*[F.avg(m).alias(m) for m in measures])
    return out.filter(F.coalesce(*[F.col(m) for m in measures]).isNotNull())
