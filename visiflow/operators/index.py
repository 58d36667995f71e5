"""Dense positions and chunked windows.

Positional time-series features (lag k, rolling w) are defined over a
*grid*: every bin timestamp that occurs for any zone is a position, and a
zone without a reading at a position still occupies it.  Materialising that
grid is a cross join of timestamps and zones; instead we

1. give every distinct bin timestamp a dense position ``pos`` (0, 1, 2 ...),
2. keep only the cells that exist, and
3. express "k positions back" as a RANGE frame on ``pos``.

A missing cell then simply has no row inside the frame, which is exactly
the grid semantics (``lag`` returns NULL, a strict rolling window is not
full).

Both steps avoid single-task plans:

* ``dense_index`` numbers rows per key without a global sort: rows are
  numbered inside (key, chunk) partitions, chunk sizes are counted, and a
  running sum over the *small* (key, chunk) count table gives each chunk
  its offset.  This is zipWithIndex expressed with DataFrame operators.
* ``chunked_window`` evaluates windows over (key, chunk-of-positions)
  partitions.  Rows within ``lookback`` positions of a chunk's end are
  copied into the next chunk as a read-only halo, so every frame that
  reaches back at most ``lookback`` positions sees the same rows as an
  unchunked window.  A zone holding a third of all rows is therefore split
  into many tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiflow.functions.times import epoch_us

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
DEFAULT_CHUNK_POSITIONS = 4096


def time_chunk(ts_col: str = "ts", chunk_us: int = HOUR_US) -> Column:
    """Chunk id of a timestamp: whole hours by default.

    Hours keep the sort inside one (key, chunk) small even for a key that
    holds a third of all raw readings, while the (key, chunk) count table
    stays small (keys x hours of the span).
    """
    return F.floor(epoch_us(F.col(ts_col)) / F.lit(chunk_us)).cast("bigint")


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                name: str = "idx") -> DataFrame:
    """Attach a 0-based consecutive index per ``keys`` in ``order``.

    ``chunk`` must be non-decreasing in ``order`` within a key (e.g. the day
    of the timestamp).  Rows are numbered inside (keys, chunk); the offset of
    each chunk is the running total of the chunk sizes before it.  The count
    table has one row per (key, chunk), so its window is small; it is
    joined back on (keys, chunk) — AQE broadcasts it when it is small
    enough and shuffles otherwise.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w))
    counts = d.groupBy(*keys, "_chunk").agg(F.max("_rn").alias("_n"))
    part = [F.col(k) for k in keys] or [F.lit(0)]
    wc = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"))
    d = d.join(offs, [*keys, "_chunk"])
    return d.select(*[F.col(f"`{c}`") for c in df.columns],
                    (F.col("_off") + F.col("_rn") - 1).cast("bigint").alias(name))


def position_axis(df: DataFrame, ts_col: str = "ts", name: str = "pos",
                  chunk_us: int = HOUR_US) -> DataFrame:
    """Dense position of every distinct timestamp of ``df`` (the grid's rows)."""
    axis = df.select(ts_col).distinct()
    return dense_index(axis, [], [ts_col], time_chunk(ts_col, chunk_us), name)


def with_positions(df: DataFrame, ts_col: str = "ts", name: str = "pos",
                   chunk_us: int = HOUR_US) -> DataFrame:
    """Attach the grid position of each row's timestamp."""
    return df.join(position_axis(df, ts_col, name, chunk_us), ts_col)


def chunked_window(df: DataFrame, keys: Sequence[str], idx: str,
                   columns: dict[str, Callable[[Callable[[int, int], Window]], Column]],
                   lookback: int, chunk_positions: int = DEFAULT_CHUNK_POSITIONS) -> DataFrame:
    """Evaluate window columns over (keys, chunk of ``idx``) partitions with a halo.

    ``columns`` maps an output name to ``fn(frame)`` where ``frame(lo, hi)``
    returns a RANGE frame spec on ``idx`` (offsets relative to the current
    row, e.g. ``frame(-2, 0)``).  Every frame must stay within ``lookback``
    positions before the current row and may not look ahead.
    """
    if lookback >= chunk_positions:
        raise ValueError("chunk must be longer than the look-back")
    keys = list(keys)
    c = F.floor(F.col(idx) / F.lit(chunk_positions)).cast("bigint")
    in_halo = (F.col(idx) % F.lit(chunk_positions)) >= F.lit(chunk_positions - lookback)
    d = df.withColumn("_home", c).withColumn(
        "_wc", F.explode(F.when(in_halo, F.array(c, c + 1)).otherwise(F.array(c))))
    base = Window.partitionBy(*keys, "_wc").orderBy(F.col(idx))

    def frame(lo: int, hi: int) -> Window:
        if hi > 0 or -lo > lookback:
            raise ValueError(f"frame ({lo}, {hi}) exceeds look-back {lookback}")
        return base.rangeBetween(lo, hi)

    d = d.withColumns({name: fn(frame) for name, fn in columns.items()})
    return d.filter(F.col("_wc") == F.col("_home")).drop("_wc", "_home")
