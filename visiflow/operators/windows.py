"""Positional window features per zone.

All features are evaluated by ``chunked_window`` over dense positions, so
one sort on (zone, chunk, position) serves every lag and rolling column and
long series split into many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.values import is_valid
from visiflow.operators.index import (DEFAULT_CHUNK_POSITIONS, chunked_window, dense_index,
                                      time_chunk, with_positions)


def _lag(value: str, k: int):
    return lambda frame: F.first(F.col(value)).over(frame(-k, -k))


def _strict(agg, value: str, w: int, include_current: bool):
    lo, hi = (-(w - 1), 0) if include_current else (-w, -1)

    def fn(frame):
        f = frame(lo, hi)
        return F.when(F.count(F.col(value)).over(f) >= w, agg(F.col(value)).over(f))
    return fn


def _lenient(agg, value: str, w: int, include_current: bool):
    lo, hi = (-(w - 1), 0) if include_current else (-w, -1)
    return lambda frame: agg(F.col(value)).over(frame(lo, hi))


def grid_features(cells: DataFrame, value: str = "rvr", keys: Sequence[str] = ("zone",), pos: str = "pos",
                  lags: Sequence[int] = C.LAGS, strict_windows: Sequence[int] = C.ROLL_WINDOWS,
                  lenient_windows: Sequence[int] = (), include_current: bool = True,
                  chunk_positions: int = DEFAULT_CHUNK_POSITIONS) -> DataFrame:
    """Lags and rolling statistics over grid positions.

    * ``lag_k``: value k positions earlier (NULL if that cell is missing).
    * ``roll_mean_w`` / ``roll_std_w``: full-window mean and sample std over
      the w positions ending at the current row (``include_current``) or
      just before it; NULL unless all w cells hold a value.
    * ``roll_mean_w_lenient``: mean of whatever values the window holds.
    """
    cols = {}
    for k in lags:
        cols[f"lag_{k}"] = _lag(value, k)
    for w in strict_windows:
        cols[f"roll_mean_{w}"] = _strict(F.avg, value, w, include_current)
        cols[f"roll_std_{w}"] = _strict(F.stddev_samp, value, w, include_current)
    for w in lenient_windows:
        cols[f"roll_mean_{w}_lenient"] = _lenient(F.avg, value, w, include_current)
    spans = [max(lags, default=0)]
    spans += [w - (0 if include_current else -1) - 1 for w in list(strict_windows) + list(lenient_windows)]
    lookback = max(spans + [1])
    return chunked_window(cells, list(keys), pos, cols, lookback, chunk_positions)


def lag_features(bins: DataFrame, value: str = "rvr", lags: Sequence[int] = C.LAGS,
                 drop_incomplete: bool = True, chunk_positions: int = DEFAULT_CHUNK_POSITIONS) -> DataFrame:
    """Grid lags per zone; with ``drop_incomplete`` rows with any NULL lag are removed."""
    cells = with_positions(bins)
    out = grid_features(cells, value, lags=lags, strict_windows=(), chunk_positions=chunk_positions)
    if drop_incomplete:
        out = out.dropna(subset=[f"lag_{k}" for k in lags])
    return out


def valid_index(readings: DataFrame, value: str = "rvr", keys: Sequence[str] = ("zone",),
                name: str = "vidx") -> DataFrame:
    """Valid readings only, numbered 0.. per zone in time order."""
    valid = readings.filter(is_valid(F.col(value)))
    return dense_index(valid, keys, ["ts"], time_chunk("ts"), name)


def valid_lag_features(readings: DataFrame, value: str = "rvr", keys: Sequence[str] = ("zone",),
                       depth: int = C.STATE_DEPTH, chunk_positions: int = DEFAULT_CHUNK_POSITIONS) -> DataFrame:
    """Lags over valid readings only (the live scorer's state), ready at depth rows.

    ``lag_1..lag_{depth-1}`` are the previous valid values of the zone;
    ``ready`` is true once the zone has ``depth`` valid readings up to and
    including this one.  Of valid readings that share key and time the least
    value counts, once (as in the stream's state).
    """
    once = (readings.filter(is_valid(F.col(value)) & F.col("ts").isNotNull())
            .groupBy(*keys, "ts").agg(F.min(value).alias(value)))
    idx = valid_index(once, value, keys)
    cols = {f"lag_{k}": _lag(value, k) for k in range(1, depth)}
    out = chunked_window(idx, list(keys), "vidx", cols, depth - 1, chunk_positions)
    return out.withColumn("ready", F.col("vidx") >= F.lit(depth - 1))


def zone_counts(df: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def temporal_split(df: DataFrame, keys: Sequence[str] = ("zone",), order: str = "ts",
                   fraction: float = C.TRAIN_FRACTION, idx: str | None = None) -> DataFrame:
    """First ``floor(n * fraction)`` rows of each zone (time order) are train."""
    keys = list(keys)
    if idx is None:
        df = dense_index(df, keys, [order], time_chunk(order), "_sidx")
        idx = "_sidx"
    n = zone_counts(df, keys)
    out = df.join(n, keys).withColumn(
        "split", F.when(F.col(idx) < F.floor(F.col("_n") * F.lit(fraction)), F.lit("train")).otherwise(F.lit("test")))
    return out.drop("_n", "_sidx")


def cv_folds(df: DataFrame, keys: Sequence[str] = ("zone",), order: str = "ts", k: int = C.CV_FOLDS,
             idx: str | None = None, name: str = "fold") -> DataFrame:
    """Contiguous k-fold assignment per zone (ntile semantics: the first n % k folds get one more row)."""
    keys = list(keys)
    if idx is None:
        df = dense_index(df, keys, [order], time_chunk(order), "_fidx")
        idx = "_fidx"
    n = zone_counts(df, keys)
    q = F.floor(F.col("_n") / k)
    r = F.col("_n") % k
    i = F.col(idx)
    big = r * (q + 1)
    fold = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1))))
    return df.join(n, keys).withColumn(name, fold.cast("bigint")).drop("_n", "_fidx")


def last_n(df: DataFrame, n: int = C.TAIL_ROWS, keys: Sequence[str] = ("zone",), order: str = "ts") -> DataFrame:
    """Newest ``n`` rows per key (row_number from the end <= n).

    The filter on the row number limits every task to its own newest ``n``
    rows per key before the shuffle, so a hot key sends n rows a task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return (df.withColumn("rank_from_end", rank).filter(F.col("rank_from_end") <= n)
            .withColumn("rank_from_end", F.col("rank_from_end").cast("bigint")))
