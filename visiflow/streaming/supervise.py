"""Runs that go on after a failed cycle, what a stream reports about itself, and rows that do not parse."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visiflow import config as C
from visiflow.sources.readings import bad_log_line, parse_log_lines

PROGRESS = ("run_id string, batch_id bigint, at timestamp, rows_in bigint, rows_dropped bigint, state_rows bigint, "
            "duration_ms bigint, watermark string, observed map<string,string>")


@dataclass
class Failure:
    attempt: int
    at: dt.datetime
    wait_s: float
    error: str


def run_supervised(start: Callable[[], StreamingQuery], retries: int = 5, wait_s: float = C.RETRY_SECONDS, most_s: float = 600.0,
                   sleep: Callable[[float], None] = time.sleep) -> tuple[StreamingQuery, list[Failure]]:
    """Run a query to its end; after a failed cycle wait and start it again from its checkpoint.

    The wait doubles with every failure in a row up to ``most_s`` and starts anew once a batch has been committed.
    After ``retries`` failures without a committed batch in between the error is raised.
    Returns the last query and the failures.
    """
    failures: list[Failure] = []
    in_a_row = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query, failures
        except StreamingQueryException as e:
            in_a_row = 1 if any(p["durationMs"].get("commitOffsets") is not None for p in progress_of(query)) else in_a_row + 1
            if in_a_row > retries:
                raise
            wait = min(most_s, wait_s * 2 ** (in_a_row - 1))
            failures.append(Failure(len(failures) + 1, dt.datetime.now(), wait, str(e).splitlines()[0][:500]))
            sleep(wait)


def progress_of(query: StreamingQuery) -> list[dict]:
    """The query's progress reports as plain dictionaries."""
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def progress_rows(spark: SparkSession, *queries: StreamingQuery) -> DataFrame:
    """One row per finished batch: rows read, rows dropped as too late, rows in state, duration, watermark, observed metrics.

    A query keeps its newest ``spark.sql.streaming.numRecentProgressUpdates`` reports.
    """
    rows = []
    for q in queries:
        for p in progress_of(q):
            ops = p.get("stateOperators", [])
            seen = {f"{n}.{k}": str(v) for n, m in (p.get("observedMetrics") or {}).items() for k, v in m.items()}
            rows.append((str(p["runId"]), p["batchId"], dt.datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")), p["numInputRows"],
                         sum(o.get("numRowsDroppedByWatermark", 0) for o in ops), sum(o.get("numRowsTotal", 0) for o in ops),
                         p["durationMs"].get("triggerExecution", 0), (p.get("eventTime") or {}).get("watermark"), seen))
    return spark.createDataFrame(rows, PROGRESS)


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Metrics of every batch (aggregates over the rows that pass here), reported with its progress."""
    return df.observe(name, *(c.alias(k) for k, c in metrics.items()))


def log_lines_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch over raw log lines: readings to ``<path>/readings``, lines that do not parse to ``<path>/bad``, by batch id."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            parse_log_lines(batch).write.mode("overwrite").parquet(f"{path}/readings/batch_id={batch_id}")
            batch.filter(bad_log_line("value")).select("value").write.mode("overwrite").parquet(f"{path}/bad/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return handle
