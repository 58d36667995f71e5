"""Streaming queries: each runs a Structured Streaming job to completion
(availableNow trigger) over the events file stream and returns its sink as
a batch DataFrame.  Where the stream must equal a batch operator, the batch
oracle is reused."""

from __future__ import annotations

from pyspark.sql import functions as F

from visiflow.functions.values import is_valid
from visiflow.operators.windows import valid_lag_features
from visiflow.plans.catalog import ORACLES, register
from visiflow.plans.q_state import latest_per_zone  # noqa: F401  (registers the batch twin first)
from visiflow.plans.q_windows import valid_lag_features_q  # noqa: F401
from visiflow.plans.scoring import fit_linear_nowcast
from visiflow.plans.sql import BINS, VALID, with_
from visiflow.session import ensure_checkpoint_dir
from visiflow.sources.readings import readings_from_events, table
from visiflow.streaming.jobs import (EVENTS_SCHEMA, ONCE, lag_rows, lag_table_sink, newest_version, readings_stream, run_dir,
                                     run_scoring_stream, stream_bins, stream_latest, versioned_sink)
from visiflow.streaming.lag_state import stream_lags, with_rocksdb
from visiflow.streaming.supervise import log_lines_sink, observed, progress_rows, run_supervised


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


@register("stream_bins", with_(BINS) + "SELECT ts, zone, round(rvr, 4) AS rvr, n_readings FROM bins")
def stream_bins_q(spark, sf_dir):
    """T1 + T6: 10-minute means per zone kept up to date by the stream; every late row counts, open bins included."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "bins")
    q = (stream_bins(readings_stream(spark, sf_dir), watermark=None).writeStream.outputMode("update")
         .foreachBatch(versioned_sink(f"{base}/out")).option("checkpointLocation", f"{base}/_checkpoint").trigger(**ONCE).start())
    q.awaitTermination()
    return newest_version(spark, f"{base}/out", ["ts", "zone"]).select("ts", "zone", r4("rvr").alias("rvr"), "n_readings")


@register("stream_lags_out_of_order", ORACLES["valid_lag_features"])
def stream_lags_out_of_order(spark, sf_dir):
    """T2 + T5: the feed arrives in two files that overlap in time; the lag table still equals the batch one."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "disorder")
    e = table(spark, sf_dir, "events")
    for part in (1, 0):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in/events{part}.parquet")
    raw = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.parquet").parquet(f"{base}/in"))
    readings = raw.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("zone"), (F.col("value") * 10.0).alias("rvr"))
    q = (readings.writeStream.foreachBatch(lag_table_sink(f"{base}/table")).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(**ONCE).start())
    q.awaitTermination()
    out = lag_rows(spark, f"{base}/table")
    return out.select("ts", "zone", r4("rvr").alias("rvr"), *[r4(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 3)], "ready")


@register("stream_valid_lags", ORACLES["valid_lag_features"])
def stream_valid_lags(spark, sf_dir):
    """Lags of the last valid readings per zone, kept up by the stream; equals the batch valid-lag table in any order of arrival."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "state")
    q = (readings_stream(spark, sf_dir).writeStream.foreachBatch(lag_table_sink(f"{base}/table"))
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(**ONCE).start())
    q.awaitTermination()
    out = lag_rows(spark, f"{base}/table")
    return out.select("ts", "zone", r4("rvr").alias("rvr"), *[r4(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 3)],
                      "ready")


@register("stream_latest", ORACLES["latest_per_zone"])
def stream_latest_q(spark, sf_dir):
    """Newest reading per zone maintained by a streaming aggregation (complete mode, overwrite sink)."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "latest")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    q = (stream_latest(readings_stream(spark, sf_dir)).writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("zone", "ts", r4("rvr").alias("rvr"))


FIT_BEFORE = "2024-01-15 00:00:00"


@register("stream_nowcast", with_(VALID) + f""",
st AS (SELECT ts, zone, rvr, vidx, lag(rvr, 1) OVER (PARTITION BY zone ORDER BY ts) AS lag_1 FROM valid),
past AS (SELECT zone, regr_intercept(rvr, lag_1) AS a, regr_slope(rvr, lag_1) AS b FROM st
         WHERE lag_1 IS NOT NULL AND ts < TIMESTAMP '{FIT_BEFORE}' GROUP BY zone)
SELECT zone, ts, round(CASE WHEN vidx >= 3 AND a IS NOT NULL AND b IS NOT NULL THEN a + b * lag_1 ELSE rvr END, 4) AS value,
  CASE WHEN vidx >= 3 AND a IS NOT NULL AND b IS NOT NULL THEN 'model' ELSE 'current' END AS source
FROM st LEFT JOIN past USING (zone)
""")
def stream_nowcast(spark, sf_dir):
    """Live state -> nowcast with fallback per micro-batch -> history (append) + latest (replace).

    The model is fitted on the readings before a fixed day; the whole feed is streamed.
    """
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "nowcast")
    past = readings_from_events(spark, sf_dir).filter(F.col("ts") < F.lit(FIT_BEFORE).cast("timestamp_ntz"))
    q = run_scoring_stream(spark, readings_stream(spark, sf_dir), fit_linear_nowcast(valid_lag_features(past)), base)
    q.awaitTermination()
    return newest_version(spark, f"{base}/history/data", ["zone", "ts"]).select("zone", "ts", r4("value").alias("value"), "source")


# -- keyed state in event time, progress, supervision ------------------------------------------------------------------

def _file_stream(spark, folder):
    raw = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.parquet").parquet(folder))
    return raw.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("zone"), (F.col("value") * 10.0).alias("rvr"))


def _land(parts, folder):
    """Each frame as one file, later files with later names and times."""
    for k, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{folder}/part={k}")


def _middle(e):
    """The middle of the feed's time span (a scalar)."""
    lo, hi = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    return (lo + hi) // 2


HOUR_US = 3_600_000_000

READINGS_IDS = """
r AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS zone, value * 10.0 AS rvr FROM events)"""


@register("stream_state_event_time", ORACLES["valid_lag_features"])
def stream_state_event_time(spark, sf_dir):
    """T2 in event time: two files that overlap by an hour; keyed state corrects the rows after late readings.

    The second file brings every other reading of the hour that the first one
    ends with.  The state holds two hours; nothing written before is read again.
    """
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "keyed")
    e = table(spark, sf_dir, "events")
    t, mid = F.unix_micros(F.col("ts").cast("timestamp")), _middle(e)
    second = (t >= mid + HOUR_US) | ((t >= mid) & (F.col("event_id") % 2 == 1))
    _land([e.filter(~second), e.filter(second)], f"{base}/in")
    lags = stream_lags(_file_stream(spark, f"{base}/in"), "2 hours")
    q = with_rocksdb(spark, lambda: lags.writeStream.outputMode("update").foreachBatch(versioned_sink(f"{base}/out"))
                     .option("checkpointLocation", f"{base}/_checkpoint").trigger(**ONCE).start())
    q.awaitTermination()
    out = newest_version(spark, f"{base}/out", ["zone", "ts"])
    return out.filter(~F.col("late")).select("ts", "zone", r4("rvr").alias("rvr"), *[r4(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 3)], "ready")


@register("stream_progress", with_(READINGS_IDS) + """,
span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM r)
SELECT count(*) AS rows_in, count_if(rvr > 0 AND rvr < 3333.0) AS rows_valid,
  count_if(rvr > 0 AND rvr < 3333.0 AND event_id % 10 = 0 AND epoch_us(ts) < lo + (hi - lo) // 3 - 7200000000) AS rows_dropped, CAST(3 AS BIGINT) AS data_batches
FROM r, span
""")
def stream_progress(spark, sf_dir):
    """A15 + T6: what a watermark stream reports of its batches: rows read, valid rows (observed), rows dropped as too late.

    Three files by time; the last also brings every tenth reading of the first third, but for its last two hours.
    """
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "progress")
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(t), F.max(t)).first()
    third = (hi - lo) // 3
    held = (F.col("event_id") % 10 == 0) & (t < lo + third - 2 * HOUR_US)
    second = (t >= lo + third) & (t < lo + 2 * third)
    _land([e.filter((t < lo + third) & ~held), e.filter(second), e.filter((t >= lo + 2 * third) | held)], f"{base}/in")
    seen = observed(_file_stream(spark, f"{base}/in"), "feed", valid=F.count_if(is_valid(F.col("rvr"))))
    q = with_rocksdb(spark, lambda: stream_lags(seen, "1 hour").writeStream.outputMode("update").foreachBatch(versioned_sink(f"{base}/out"))
                     .option("checkpointLocation", f"{base}/_checkpoint").trigger(**ONCE).start())
    q.awaitTermination()
    rows = progress_rows(spark, q)
    valid = F.col("observed")["feed.valid"].cast("bigint")
    return rows.agg(F.sum("rows_in").alias("rows_in"), F.sum(valid).alias("rows_valid"), F.sum("rows_dropped").alias("rows_dropped"),
                    F.count_if(F.col("rows_in") > 0).alias("data_batches"))


@register("stream_log_lines", """
WITH r AS (SELECT event_id, event_type AS zone, floor(value * 10.0) AS v FROM events),
good AS (SELECT * FROM r WHERE event_id % 17 <> 0 AND event_id % 19 <> 0)
SELECT upper(zone) AS zone, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM good GROUP BY 1
UNION ALL SELECT NULL, count(*), NULL FROM r WHERE event_id % 17 = 0 OR event_id % 19 = 0
""")
def stream_log_lines(spark, sf_dir):
    """T5: raw log lines as a supervised stream; readings per zone, and the number of lines that do not parse (zone null)."""
    ensure_checkpoint_dir(spark)
    base = run_dir(spark, "lines")
    e = table(spark, sf_dir, "events")
    value = F.floor(F.col("value") * 10.0).cast("bigint").cast("string")
    line = F.concat_ws("\t", F.date_format("ts", "dd-MM-yyyy"), F.date_format("ts", "HH:mm:ss"), F.concat("event_type", F.lit(" "), value))
    broken = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("31-02-2024"), F.substr(line, F.lit(11)))).when(F.col("event_id") % 19 == 0, F.replace(line, F.lit("\t"), F.lit(" ")))
    e.select(F.coalesce(broken, line).alias("value")).write.text(f"{base}/in")

    def start():
        return (spark.readStream.text(f"{base}/in").writeStream.foreachBatch(log_lines_sink(f"{base}/out"))
                .option("checkpointLocation", f"{base}/_checkpoint").trigger(**ONCE).start())

    run_supervised(start)
    good = spark.read.parquet(f"{base}/out/readings").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("rvr").alias("total"))
    bad = spark.read.parquet(f"{base}/out/bad").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad.select(F.lit(None).cast("string").alias("zone"), "n", F.lit(None).cast("double").alias("total")))
