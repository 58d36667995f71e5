"""Keyed state in event time (T2): a zone's recent valid readings, corrected when a late one arrives.

Per zone the state holds, sorted by time, the readings that a late one can
still change (those the watermark has not passed) and the ``depth - 1`` before
them.  A batch's readings are merged in; for each one that is new, and for the
``depth - 1`` after it, the row with its lags goes out again.  Readers take the
row of the newest batch (``jobs.newest_version``), so that the table equals the
batch operator ``valid_lag_features`` as long as no reading is later than the
watermark's delay; nothing that was written before is read again.

Once the watermark passes a reading it is final: all but the newest
``depth - 1`` final ones leave the state.  An event-time timer does the same for
a zone that reports no more.  A reading older than the newest final one cannot
be placed: it goes out with ``late`` set and no lags (Spark itself drops what is
older than the watermark of the batch before and counts it, see
``supervise.progress_rows``).

A zone's task holds a bounded part of all this: a batch's readings are sorted in
runs (``RUN`` readings in memory, further runs in a temporary file), the state
lies in the store as blocks of ``BLOCK`` readings in time order, and both are
merged, sent out and stored again block by block.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from visiflow import config as C
from visiflow.functions.values import is_valid

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Readings of a batch that are sorted in memory at once, and readings of a block of the state.
RUN, BLOCK = 1 << 20, 1 << 14

READING = np.dtype([("us", np.int64), ("v", np.float64)])
NONE = np.empty(0, READING)


def merged(held_us: np.ndarray, held: np.ndarray, us: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Held and new readings by time, of one time the least value, and which of them are new or changed."""
    t, x, new = np.concatenate([held_us, us]), np.concatenate([held, v]), np.repeat([False, True], [len(held_us), len(us)])
    order = np.lexsort((new, x, t))                    # an equal reading seen again is the held one
    t, x, new = t[order], x[order], new[order]
    once = np.append(True, t[1:] != t[:-1])[:len(t)]
    return t[once], x[once], new[once]


def readings(us: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.empty(len(us), READING)
    out["us"], out["v"] = us, v
    return out


class Runs:
    """A batch's readings as runs sorted by time, of one time the least value: the last one in memory, those before it in a temporary file."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size, self.file, self.places = 0, None, []

    def add(self, us: np.ndarray, v: np.ndarray) -> None:
        self.parts.append(readings(us, v))
        self.size += len(us)
        if self.size >= RUN:
            run = self._sorted()
            if self.file is None:       # in Spark's own folder where there is one; it has no name and goes when closed
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            self.places.append((self.file.tell(), len(run)))
            self.file.write(run.data)

    def _sorted(self) -> np.ndarray:
        r, self.parts, self.size = np.concatenate([NONE, *self.parts]), [], 0
        us, v, _ = merged(NONE["us"], NONE["v"], r["us"], r["v"])
        return readings(us, v)

    def _stored(self, at: int, n: int) -> Iterator[np.ndarray]:
        for k in range(0, n, BLOCK):
            yield np.frombuffer(os.pread(self.file.fileno(), min(BLOCK, n - k) * READING.itemsize, at + k * READING.itemsize), READING)

    def sources(self) -> list[Iterator[np.ndarray]]:
        last = self._sorted()
        if self.file is not None:
            self.file.flush()
        return [*(self._stored(*x) for x in self.places), (last[k:k + BLOCK] for k in range(0, len(last), BLOCK))]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def in_order(held: Iterator[np.ndarray], runs: list[Iterator[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``merged`` gives of all held and new readings, part by part; each source comes in blocks by time, without repeats."""
    sources = [held, *runs]
    ahead = [next(s, None) for s in sources]
    while any(a is not None for a in ahead):
        to = min(a["us"][-1] for a in ahead if a is not None)      # every source's readings up to here are at hand
        parts = []
        for i, a in enumerate(ahead):
            n = 0 if a is None else int(np.searchsorted(a["us"], to, "right"))
            parts.append(NONE if a is None else a[:n])
            if n:
                ahead[i] = a[n:] if n < len(a) else next(sources[i], None)
        new = np.concatenate([NONE, *parts[1:]])
        yield merged(parts[0]["us"], parts[0]["v"], new["us"], new["v"])


class Keeping:
    """Stores readings that come in time order: those that may still change and the ``context`` ones before them."""

    def __init__(self, put, watermark_us: int, context: int):
        self.put, self.watermark_us, self.context = put, watermark_us, context
        self.waiting, self.size = [], 0
        self.before, self.passed, self.last = NONE, None, None      # the newest that the watermark passed, and its time; the last time not passed

    def add(self, us: np.ndarray, v: np.ndarray) -> None:
        r, n = readings(us, v), int(np.searchsorted(us, self.watermark_us))
        if n:
            self.passed = int(us[n - 1])
            before = np.concatenate([self.before, r[:n]])
            self.before = before[max(0, len(before) - self.context):]
        if n < len(r):
            self._wait(self.before, r[n:])
            self.before, self.last = NONE, int(us[-1])

    def _wait(self, *parts: np.ndarray) -> None:
        self.waiting += parts
        self.size += sum(map(len, parts))
        if self.size >= BLOCK:
            r = np.concatenate(self.waiting)
            whole = self.size - self.size % BLOCK
            for k in range(0, whole, BLOCK):
                self.put(r[k:k + BLOCK])
            self.waiting, self.size = [r[whole:].copy()], self.size - whole

    def end(self) -> None:
        self._wait(self.before)
        if self.size:
            self.put(np.concatenate(self.waiting))


class LagProcessor(StatefulProcessor):
    def __init__(self, depth: int = C.STATE_DEPTH):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getMapState("recent", "block bigint", "readings binary")
        self.blocks = handle.getValueState("blocks", "first bigint, after bigint")
        self.final = handle.getValueState("final", "ts_us bigint")

    def _range(self) -> tuple[int, int]:
        return tuple(self.blocks.get()) if self.blocks.exists() else (0, 0)

    def _held(self, take: bool = True) -> Iterator[np.ndarray]:
        """The state's blocks in time order; those taken leave it."""
        for k in range(*self._range()):
            block = np.frombuffer(bytes(self.recent.getValue((k,))[0]), READING)
            if take:
                self.recent.removeKey((k,))
            yield block

    def _kept(self, parts: Iterator[tuple[np.ndarray, ...]], watermark_us: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Hands on the parts, all in time order, and stores what may still change and its context; the last one passed is final."""
        first = after = self._range()[1]

        def put(block: np.ndarray) -> None:
            nonlocal after
            self.recent.updateValue((after,), (block.tobytes(),))
            after += 1

        keeping = Keeping(put, watermark_us, self.depth - 1)
        some = False
        for part in parts:
            keeping.add(*part[:2])
            some = True
            yield part
        if not some:
            return
        keeping.end()
        self.blocks.update((first, after))
        if keeping.passed is not None:
            self.final.update((keeping.passed,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if keeping.last is not None:
            self.handle.registerTimer(keeping.last // 1000 + 1)

    def _out(self, key, us: np.ndarray, v: np.ndarray, lags: list[np.ndarray], ready, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"zone": key[0], "ts_us": us, "rvr": v, **{f"lag_{k}": x for k, x in enumerate(lags, 1)}, "ready": ready, "late": late})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d, runs = self.depth - 1, Runs()
        try:
            final = self.final.get()[0] if self.final.exists() else None
            context = NONE["us"]                            # held readings that are final
            for block in self._held(take=False) if final is not None else ():
                context = np.append(context, block["us"][block["us"] <= final])
                if block["us"][-1] > final:
                    break
            for p in rows:
                us, v = p["ts_us"].to_numpy(np.int64), p["rvr"].to_numpy(float)
                if final is not None and (late := (us <= final) & ~np.isin(us, context)).any():    # a held reading seen again is not late
                    none = np.full(int(late.sum()), np.nan)
                    yield self._out(key, us[late], v[late], [none] * d, False, True)
                    us, v = us[~late], v[~late]
                runs.add(us, v)
            seen, before, before_new = 0, np.full(d, np.nan), np.zeros(d, bool)
            watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
            for t, x, new in self._kept(in_order(self._held(), runs.sources()), watermark_us):
                n, values, changed = len(t), np.concatenate([before, x]), np.concatenate([before_new, new])
                touched = new.copy()
                for k in range(1, self.depth):              # the rows whose lags hold a new reading
                    touched |= changed[d - k:d - k + n]
                at = np.flatnonzero(touched)
                if len(at):
                    yield self._out(key, t[at], x[at], [values[d + at - k] for k in range(1, self.depth)], seen + at >= d, False)
                seen, before, before_new = seen + n, values[n:], changed[n:]
        finally:
            runs.close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for _ in self._kept(((b["us"], b["v"]) for b in self._held()), timerValues.getCurrentWatermarkInMs() * 1000):
            pass
        return iter(())

    def close(self) -> None:
        pass


def stream_lags(readings: DataFrame, delay: str, depth: int = C.STATE_DEPTH) -> DataFrame:
    """zone, ts, rvr, lag_1.., ready, late of a stream ``readings(ts, zone, rvr)``; rows go out again when corrected.

    Needs the RocksDB state store (``with_rocksdb``).  Readings that are not valid are left out before the state.
    """
    lags = [f"lag_{k}" for k in range(1, depth)]
    schema = ", ".join(["zone string, ts_us bigint, rvr double", *(f"{x} double" for x in lags), "ready boolean, late boolean"])
    valid = (readings.filter(is_valid(F.col("rvr")) & F.col("ts").isNotNull()).withColumn("t", F.col("ts").cast("timestamp"))
             .select("zone", "t", F.unix_micros("t").alias("ts_us"), F.col("rvr").cast("double").alias("rvr")))
    out = (valid.withWatermark("t", delay).groupBy("zone")
           .transformWithStateInPandas(LagProcessor(depth), schema, "Update", "EventTime"))
    # pandas marks a missing lag as NaN
    clean = [F.when(~F.isnan(x), F.col(x)).alias(x) for x in lags]
    return out.select("zone", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "rvr", *clean, "ready", "late")


def with_rocksdb(spark, start):
    """Start a query with the RocksDB state store; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
