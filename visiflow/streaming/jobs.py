"""Structured Streaming jobs: binning, live state + scoring, latest per zone.

Sources are file streams (new files are picked up by offset, not by
re-reading everything); every query has a checkpoint location under the
cluster's shared checkpoint folder, so a restart after a lost executor or
driver resumes from the last committed batch.  Sinks are idempotent:
``foreachBatch`` writes each batch under its batch id and skips ids that
were already committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from visiflow import config as C
from visiflow.plans.scoring import fallback_chain, linear_nowcast
from visiflow.functions.values import is_valid
from visiflow.operators.state import latest_per_key
from visiflow.operators.windows import last_n, valid_lag_features
from visiflow.session import materialize, shared_path
from visiflow.streaming.state import OUTPUT_SCHEMA, STATE_SCHEMA, live_state

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def run_dir(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"visiflow-stream/{name}-{uuid.uuid4().hex[:8]}")


def readings_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Stand-in sensor stream: the events file(s) as a file stream, renamed to readings."""
    raw = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
           .option("pathGlobFilter", "events*.parquet").parquet(sf_dir))
    return raw.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("zone"),
                      (F.col("value") * 10.0).alias("rvr"))


def stream_bins(readings: DataFrame, minutes: int = C.BIN_MINUTES, watermark: str | None = "10 minutes") -> DataFrame:
    """10-minute mean per zone.

    With a watermark a bin is final once it passes (append mode) and later
    rows are dropped.  Without one every late row counts: run it in update
    mode into ``versioned_sink``; the state is one row per (bin, zone).
    """
    r = readings.filter(F.col("rvr").isNotNull()).withColumn("_t", F.col("ts").cast("timestamp"))
    return ((r.withWatermark("_t", watermark) if watermark else r)
            .groupBy(F.window("_t", f"{minutes} minutes").alias("w"), "zone")
            .agg(F.avg("rvr").alias("rvr"), F.count("rvr").alias("n_readings"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("ts"), "zone", "rvr", "n_readings"))


def stream_state(readings: DataFrame) -> DataFrame:
    """Keyed state of the newest valid readings per zone -> lags per valid reading."""
    return readings.groupBy("zone").applyInPandasWithState(
        live_state, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_latest(readings: DataFrame) -> DataFrame:
    """Newest reading per zone, maintained as a streaming aggregation (update mode)."""
    return readings.groupBy("zone").agg(F.max("ts").alias("ts"), F.max_by("rvr", "ts").alias("rvr"))


#: Triggers: all that is there now, or the source system's update period.
ONCE, LIVE = {"availableNow": True}, {"processingTime": f"{C.UPDATE_SECONDS} seconds"}


def write_parquet_stream(df: DataFrame, out: str, checkpoint: str, mode: str = "append", trigger: dict = ONCE):
    return (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(**trigger).start())


def versioned_sink(path: str):
    """foreachBatch: every batch's rows in a folder of its own (a replay overwrites its own folder)."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def newest_version(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of a versioned table the row of the newest batch for every key."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in [*keys, "batch_id"]]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in cols])


# ---------------------------------------------------------------------------
# lag table: laid out by day, read from the batch's earliest day on
# ---------------------------------------------------------------------------

def _children(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, str]]:
    """(number, path) of the folders ``<prefix><number>`` below a path, in order (a listing, no job)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted((int(n[len(prefix):]), f"{path}/{n}") for n in names if n.startswith(prefix))


def _days_of(spark: SparkSession, path: str, batch_id: int) -> list[tuple[int, str]]:
    """The day folders that hold rows of a batch."""
    return [(d, p) for d, p in _children(spark, path, "day=") if batch_id in (k for k, _ in _children(spark, p, "batch_id="))]


def read_days(spark: SparkSession, path: str, schema: str, days: list[tuple[int, str]]) -> DataFrame:
    """Rows of some day folders of a table written by ``write_days``, with ``day`` and ``batch_id``."""
    full = f"{schema}, day bigint, batch_id bigint"
    if not days:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*(p for _, p in days))


def write_days(df: DataFrame, path: str, batch_id: int) -> None:
    """Write ``df`` (with ``day``) below ``<path>/day=../batch_id=..``; a replay replaces its own folders."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).hint("rebalance", "day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path))


READING, TAIL = "zone string, ts timestamp_ntz, rvr double", "zone string, tail array<struct<ts:timestamp_ntz,rvr:double>>"


def _day(ts) -> Column:
    return F.unix_date(F.to_date(ts)).cast("bigint")


def _tails(rows: DataFrame, context: DataFrame, days: list[int], n: int) -> DataFrame:
    """(zone, day, tail): each zone's newest ``n`` readings up to the end of every day of ``days``.

    ``rows`` (zone, ts, rvr, day) lie on those days, ``context`` (zone, tail) before them.
    """
    per_day = (last_n(rows, n, ["zone", "day"]).groupBy("zone", "day")
               .agg(F.collect_list(F.struct("ts", "rvr")).alias("part")))
    zones = rows.select("zone").union(context.select("zone")).distinct()
    grid = zones.withColumn("day", F.explode(F.array(*(F.lit(d).cast("bigint") for d in days))))
    so_far = F.flatten(F.collect_list("part").over(Window.partitionBy("zone").orderBy("day")))
    got = (grid.join(per_day, ["zone", "day"], "left").withColumn("seen", so_far).join(context, "zone", "left")
           .withColumn("all", F.sort_array(F.concat(F.coalesce("tail", F.array().cast("array<struct<ts:timestamp_ntz,rvr:double>>")), "seen"))))
    return got.select("zone", "day", F.slice("all", F.greatest(F.lit(1), F.size("all") - n + 1), n).alias("tail"))


def lag_table_sink(path: str, depth: int = C.STATE_DEPTH):
    """T2 for feeds out of order: a lag table that equals the batch operator in any order of arrival.

    Three tables lie under ``path``, each by day and batch id: the valid
    ``readings``; their ``lags``; and ``tails``, every zone's newest
    ``depth - 1`` readings up to the end of a day.  A batch reads the days from
    its earliest reading on and one day of tails before them, whatever the
    length of the feed's past, and derives the rows of its zones from their
    earliest new reading on again.  ``newest_version`` reads the lags;
    ``compact_lags`` leaves one version of days that are done.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        valid = (batch.filter(is_valid(F.col("rvr")) & F.col("ts").isNotNull())
                 .select("zone", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("rvr").cast("double").alias("rvr")).withColumn("day", _day("ts")))
        write_days(valid, f"{path}/readings", batch_id)
        # the days of this batch: those with a folder of its id
        own = _days_of(spark, f"{path}/readings", batch_id)
        if not own:
            return
        days = [x for x in _children(spark, f"{path}/readings", "day=") if x[0] >= own[0][0]]
        stored = read_days(spark, f"{path}/readings", READING, days).filter(F.col("batch_id") <= batch_id)
        once = stored.groupBy("zone", "ts", "day").agg(F.min("rvr").alias("rvr"))
        old = [x for x in _children(spark, f"{path}/tails", "day=") if x[0] < own[0][0]][-1:]
        context = (read_days(spark, f"{path}/tails", TAIL, old).filter(F.col("batch_id") <= batch_id)
                   .groupBy("zone").agg(F.max_by("tail", "batch_id").alias("tail")))
        before = context.select("zone", F.explode("tail").alias("r")).select("zone", "r.ts", "r.rvr")
        from_ts = stored.filter(F.col("batch_id") == batch_id).groupBy("zone").agg(F.min("ts").alias("from_ts"))
        rows = once.select("zone", "ts", "rvr").unionByName(before).join(from_ts, "zone")
        start = last_n(rows.filter(F.col("ts") < F.col("from_ts")), depth - 1).drop("rank_from_end")
        lags = valid_lag_features(rows.filter(F.col("ts") >= F.col("from_ts")).unionByName(start).select("zone", "ts", "rvr"), depth=depth)
        lags = lags.join(from_ts, "zone").filter(F.col("ts") >= F.col("from_ts")).drop("from_ts", "vidx")
        write_days(lags.withColumn("day", _day("ts")), f"{path}/lags", batch_id)
        write_days(_tails(once, context, [d for d, _ in days], depth - 1), f"{path}/tails", batch_id)

    return handle


def lag_rows(spark: SparkSession, path: str, batch_id: int | None = None, depth: int = C.STATE_DEPTH) -> DataFrame:
    """Rows of a lag table: the newest version of each, or those that one batch wrote."""
    lags = [f"lag_{k}" for k in range(1, depth)]
    schema = ", ".join([READING, *(f"{x} double" for x in lags), "ready boolean"])
    if batch_id is not None:
        return read_days(spark, f"{path}/lags", schema, _days_of(spark, f"{path}/lags", batch_id)).filter(F.col("batch_id") == batch_id).drop("day", "batch_id")
    df = read_days(spark, f"{path}/lags", schema, _children(spark, f"{path}/lags", "day="))
    return df.groupBy("zone", "ts").agg(*[F.max_by(c, "batch_id").alias(c) for c in ["rvr", *lags, "ready"]])


def compact_lags(spark: SparkSession, path: str, before_day: int, depth: int = C.STATE_DEPTH) -> int:
    """Leave one version of the lags of every day before ``before_day``; returns the number of folders removed.

    The newest versions are written under the day's highest batch id (with the rows that id already has), then the
    folders below it go.  A crash in between leaves rows that the higher id overrules.  Run it between batches.
    """
    jvm = spark.sparkContext._jvm
    removed = 0
    for day, folder in _children(spark, f"{path}/lags", "day="):
        versions = _children(spark, folder, "batch_id=")
        if day >= before_day or len(versions) < 2:
            continue
        lags = [f"lag_{k}" for k in range(1, depth)]
        df = read_days(spark, f"{path}/lags", ", ".join([READING, *(f"{x} double" for x in lags), "ready boolean"]), [(day, folder)])
        newest = df.groupBy("zone", "ts", "day").agg(*[F.max_by(c, "batch_id").alias(c) for c in ["rvr", *lags, "ready"]])
        write_days(materialize(newest), f"{path}/lags", versions[-1][0])
        for _, p in versions[:-1]:
            h = jvm.org.apache.hadoop.fs.Path(p)
            h.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(h, True)
            removed += 1
    return removed


def _latest_version(spark: SparkSession, path: str, below: int) -> str | None:
    """Newest committed version folder ``v=<batch id>`` under a batch id (a listing, no job)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    vs = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            vs += [int(name[2:])] if int(name[2:]) < below else []
    return f"{path}/v={max(vs)}" if vs else None


def scoring_sink(coefs: DataFrame, history_path: str, latest_path: str):
    """T3 + T4: score each micro-batch, append history (by run date), replace the latest table.

    The latest table is the previous version (one row per zone) merged with
    the batch's newest rows, so a batch never re-reads the history.  A batch
    id that was already committed is skipped, so a replayed batch after a
    failure writes nothing twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marker = f"{history_path}/_batches/batch_id={batch_id}"
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(marker)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hpath):
            return
        batch = batch.persist()     # read by the history and the latest table
        fresh = batch.dropDuplicates(["zone", "ts"])
        scored = fallback_chain(linear_nowcast(fresh.withColumnRenamed("rvr", "current"), coefs))
        scored = scored.withColumn("run_date", F.to_date("ts"))
        # one folder per batch id, overwritten on replay: history never holds a batch twice
        (scored.write.mode("overwrite").partitionBy("run_date")
         .parquet(f"{history_path}/data/batch_id={batch_id}"))
        cur = scored.select("zone", "ts", "value", "source")
        prev = _latest_version(spark, latest_path, batch_id)
        if prev:    # a reading scored again replaces its earlier value
            cur = cur.unionByName(spark.read.parquet(prev).join(cur.select("zone", "ts"), ["zone", "ts"], "left_anti"))
        latest_per_key(cur).write.mode("overwrite").parquet(f"{latest_path}/v={batch_id}")
        spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("overwrite").parquet(marker)
        batch.unpersist()

    return handle


def run_scoring_stream(spark: SparkSession, readings: DataFrame, coefs: DataFrame, base: str, trigger: dict = ONCE):
    """T1-T5 wired together; returns the started query.  The fit is computed once, not per batch.

    Every batch scores the rows of the lag table that it adds or corrects, so
    readings in any order of arrival count; ``newest_version`` reads the history.
    """
    table = f"{base}/table"
    lags, score = lag_table_sink(table), scoring_sink(materialize(coefs), f"{base}/history", f"{base}/latest")

    def handle(batch: DataFrame, batch_id: int) -> None:
        lags(batch, batch_id)
        score(lag_rows(batch.sparkSession, table, batch_id), batch_id)

    return (readings.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{base}/_checkpoint").trigger(**trigger).start())
