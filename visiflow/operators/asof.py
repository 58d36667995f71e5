"""As-of joins (backward, forward, nearest) without candidate fan-out.

Spark's public DataFrame API has no as-of join.  This one is composed of
built-ins and emits no (left, right) pairs:

1. Distinct left keys ``(by, ts)`` and the right rows are put in one union,
   partitioned by ``(by, bucket)`` where ``bucket = floor(ts / width)``.
2. Inside a bucket, ``last(payload, ignorenulls)`` over a running frame
   gives the newest right row at or before each left key (backward);
   ``first(..)`` over a following frame gives the forward candidate.
3. A left key whose match lies in an earlier (later) bucket takes it from a
   small carry table: the last (first) right row of every earlier (later)
   bucket, one row per (by, bucket).
4. Candidates beyond the tolerance are dropped; ``nearest`` keeps the
   closer one, the earlier on a tie.  The result is joined back to the left
   rows, which are always kept (left outer).

Because partitions are (by, time bucket), a hot ``by`` key is spread over
many tasks; work is linear in the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visiflow.functions.times import epoch_us

MINUTE_US = 60_000_000
DEFAULT_BUCKET_MIN = 10


def asof_join(left: DataFrame, right: DataFrame, on: str = "ts", by: Sequence[str] = (),
              tolerance_minutes: float | None = None, direction: str = "nearest",
              right_cols: Sequence[str] | None = None, prefix: str = "right_",
              bucket_minutes: float | None = None) -> DataFrame:
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(direction)
    by = list(by)
    right_cols = list(right_cols) if right_cols is not None else [c for c in right.columns if c not in by + [on]]
    tol_us = None if tolerance_minutes is None else int(tolerance_minutes * MINUTE_US)
    # the carry table reaches across any number of buckets, so the bucket width
    # only sizes the sort partitions: the tolerance, or 10 minutes of one key
    # when the join is unbounded
    width = max(int((bucket_minutes or tolerance_minutes or DEFAULT_BUCKET_MIN) * MINUTE_US), 1)

    payload = F.struct(F.col(on).alias("_rts"), *[F.col(c).alias(c) for c in right_cols])
    r = right.filter(F.col(on).isNotNull()).select(*by, F.col(on).alias("_t"), payload.alias("_p"))
    ptype = r.schema["_p"].dataType
    keys = left.select(*by, F.col(on).alias("_t")).filter(F.col("_t").isNotNull()).distinct()

    bucket = F.floor(epoch_us(F.col("_t")) / F.lit(width)).cast("bigint")
    r = r.withColumn("_b", bucket)
    keys = keys.withColumn("_b", bucket)
    u = (keys.select(*by, "_t", "_b", F.lit(1).alias("_l"), F.lit(None).cast(ptype).alias("_p"))
         .unionByName(r.select(*by, "_t", "_b", F.lit(0).alias("_l"), "_p")))
    part = Window.partitionBy(*by, "_b")
    cols = {}
    if direction in ("backward", "nearest"):
        wb = part.orderBy("_t", "_l", "_p").rowsBetween(Window.unboundedPreceding, 0)
        cols["_bk"] = F.last("_p", ignorenulls=True).over(wb)
    if direction in ("forward", "nearest"):
        wf = part.orderBy("_t", F.col("_l").desc(), "_p").rowsBetween(0, Window.unboundedFollowing)
        cols["_fw"] = F.first("_p", ignorenulls=True).over(wf)
    cand = u.withColumns(cols).filter(F.col("_l") == 1).drop("_l", "_p")

    # carry table: one row per (by, bucket) with the edge right rows
    edges = r.groupBy(*by, "_b").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    bks = cand.select(*by, "_b").distinct().unionByName(edges.select(*by, "_b")).distinct()
    carry = bks.join(edges, [*by, "_b"], "left")
    cpart = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)])).orderBy("_b")
    ccols = {}
    if "_bk" in cols:
        ccols["_cbk"] = F.last("_last", ignorenulls=True).over(cpart.rowsBetween(Window.unboundedPreceding, -1))
    if "_fw" in cols:
        ccols["_cfw"] = F.first("_first", ignorenulls=True).over(cpart.rowsBetween(1, Window.unboundedFollowing))
    carry = carry.select(*by, "_b", *[v.alias(k) for k, v in ccols.items()])
    cand = cand.join(carry, [*by, "_b"], "left")

    t_us = epoch_us(F.col("_t"))
    best = None
    if "_bk" in cols:
        bk = F.coalesce(F.col("_bk"), F.col("_cbk"))
        dist_b = t_us - epoch_us(bk["_rts"])
        if tol_us is not None:
            bk = F.when(dist_b <= F.lit(tol_us), bk)
        cand = cand.withColumn("_bsel", bk).withColumn("_bd", dist_b)
        best = F.col("_bsel")
    if "_fw" in cols:
        fw = F.coalesce(F.col("_fw"), F.col("_cfw"))
        dist_f = epoch_us(fw["_rts"]) - t_us
        if tol_us is not None:
            fw = F.when(dist_f <= F.lit(tol_us), fw)
        cand = cand.withColumn("_fsel", fw).withColumn("_fd", dist_f)
        best = F.col("_fsel")
    if direction == "nearest":
        best = (F.when(F.col("_bsel").isNull(), F.col("_fsel"))
                .when(F.col("_fsel").isNull(), F.col("_bsel"))
                .when(F.col("_bd") <= F.col("_fd"), F.col("_bsel"))
                .otherwise(F.col("_fsel")))
    matched = cand.select(*by, F.col("_t").alias(on), best.alias("_m"))
    out = left.join(matched, [*by, on], "left")
    sel = [F.col("_m._rts").alias(f"{prefix}{on}")] + [F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in right_cols]
    return out.select(*left.columns, *sel)

