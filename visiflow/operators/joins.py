"""Equi-joins between feeds, cross-zone features and alignment joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner",
              suffixes: tuple[str, str] = ("_para", "_wind")) -> DataFrame:
    """Equi-join two feeds; columns present on both sides (other than keys) get suffixes.

    The strategy (broadcast, shuffled hash, sort-merge) is left to Catalyst
    and AQE, which see the real sizes.
    """
    keys = list(keys)
    both = (set(a.columns) & set(b.columns)) - set(keys)
    a2 = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) if c in both else F.col(c) for c in a.columns if c not in keys])
    b2 = b.select(*keys, *[F.col(c).alias(c + suffixes[1]) if c in both else F.col(c) for c in b.columns if c not in keys])
    return a2.join(b2, keys, how)


def union_feeds(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column missing from a frame is NULL there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def zone_ranks(cells: DataFrame, zone: str = "zone") -> DataFrame:
    """1-based rank of every distinct zone by name (one row per zone: a small dimension)."""
    z = cells.select(zone).distinct()
    return z.withColumn("zrank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(zone)))


def cross_zone_features(cells: DataFrame, k: int = 5, value: str = "rvr", zone: str = "zone",
                        ts: str = "ts", lag: int = 0) -> DataFrame:
    """Values of the first ``k`` other zones (by name order) at the same time.

    For a zone of rank q, the i-th other zone is rank i when i < q, else
    rank i + 1, so only the first k + 1 zones' values per time are needed:
    they are gathered with one aggregation on ``ts`` (a shuffle on ts) and
    joined back on ``ts``.  ``lag=1`` takes them from the previous bin
    position instead (no look-ahead); positions must then exist as ``pos``.
    """
    ranks = zone_ranks(cells, zone)
    c = cells.join(ranks, zone)          # zone dimension: AQE broadcasts it
    top = c.filter(F.col("zrank") <= k + 1)
    key = ts if lag == 0 else "pos"
    wide = top.groupBy(key).agg(*[F.max(F.when(F.col("zrank") == i, F.col(value))).alias(f"_v{i}")
                                  for i in range(1, k + 2)])
    if lag:
        wide = wide.withColumn(key, F.col(key) + lag)
    arr = F.array(*[F.col(f"_v{i}") for i in range(1, k + 2)])
    out = c.join(wide, key, "left").withColumn("_arr", arr)
    others = {f"other_{i}": F.element_at("_arr", F.when(F.col("zrank") <= i, i + 1).otherwise(i)) for i in range(1, k + 1)}
    return out.withColumns(others).drop("_arr", "zrank", *[f"_v{i}" for i in range(1, k + 2)])
