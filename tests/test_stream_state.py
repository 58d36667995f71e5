"""Keyed state in event time, the lag table's storage, supervised runs, progress rows, lines that do not parse."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from visiflow.operators.windows import valid_lag_features
from visiflow.streaming import jobs as J
from visiflow.streaming import lag_state as L
from visiflow.streaming.lag_state import merged, stream_lags, with_rocksdb
from visiflow.streaming.supervise import observed, progress_rows, run_supervised

SCHEMA = "ts timestamp_ntz, zone string, rvr double"
T0 = dt.datetime(2024, 3, 1)
COLUMNS = ["zone", "ts", "rvr", "lag_1", "lag_2", "lag_3", "ready"]


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def land(spark, folder, batches):
    """Every batch as one file, read one a trigger in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b={k}")
        for f in os.listdir(f"{folder}/b={k}"):
            os.utime(f"{folder}/b={k}/{f}", (1_700_000_000 + 10 * k,) * 2)
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").parquet(folder))


def run(spark, stream, base, delay):
    q = with_rocksdb(spark, lambda: stream_lags(stream, delay).writeStream.outputMode("update").foreachBatch(J.versioned_sink(f"{base}/out"))
                     .option("checkpointLocation", f"{base}/cp").trigger(**J.ONCE).start())
    q.awaitTermination()
    return q, J.newest_version(spark, f"{base}/out", ["zone", "ts"])


def batch_rows(spark, batches):
    rows = [r for b in batches for r in b]
    return sorted(tuple(r) for r in valid_lag_features(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).collect())


def test_merged_keeps_the_least_value_of_a_time():
    t, x, new = merged(np.array([10, 30]), np.array([1.0, 3.0]), np.array([20, 30, 30, 10]), np.array([2.0, 2.5, 9.0, 1.0]))
    assert t.tolist() == [10, 20, 30] and x.tolist() == [1.0, 2.0, 2.5] and new.tolist() == [False, True, True]


class Store:
    """A zone's state in plain Python; ``most`` is the largest number of readings put in at once."""

    def __init__(self):
        self.values, self.timers, self.most = {}, set(), 0

    def getValueState(self, name, schema):
        return State(self, name)

    getListState = getValueState

    def getMapState(self, name, key, value):
        return State(self, name)

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        return self.name in self.store.values

    def get(self):
        return self.store.values[self.name]

    def update(self, value):
        self.store.values[self.name] = value

    def put(self, rows):
        self.store.values[self.name], self.store.most = rows, max(self.store.most, len(rows))

    def getValue(self, key):
        return self.store.values[self.name, key]

    def updateValue(self, key, value):
        self.store.values[self.name, key], self.store.most = value, max(self.store.most, len(value[0]) // 16)

    def removeKey(self, key):
        del self.store.values[self.name, key]


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def keyed(batches, depth=4):
    """Rows of every batch ([times in us], [values], watermark in ms), the longest frame sent out, and the store."""
    made, store = L.LagProcessor(depth), Store()
    made.init(store)
    rows, longest = [], 0
    for us, v, ms in batches:
        parts = (pd.DataFrame({"ts_us": us[k:k + 50], "rvr": v[k:k + 50]}) for k in range(0, len(us), 50))
        sent = list(made.handleInputRows(("a",), parts, Watermark(ms)) if len(us) else made.handleExpiredTimer(("a",), Watermark(ms), None))
        longest = max([longest, *map(len, sent)])
        rows.append(sorted(tuple(r) for f in sent for r in f.fillna(-1.0).itertuples(index=False)))
    return rows, longest, store


@pytest.mark.parametrize("seed", range(4))
def test_a_zone_of_any_size_is_kept_and_sent_out_block_by_block(monkeypatch, seed):
    rng, batches = np.random.default_rng(seed), []
    for k in range(6):
        us = rng.integers(max(0, k * 400 - 800), k * 400 + 1500, 900) * 1000      # repeats, and readings of all ages
        batches.append((us, rng.integers(1, 50, 900).astype(float), max(0, k * 400 - 100)))
    batches.append(([], [], 10_000))                                # the timer
    want, _, whole = keyed(batches)
    monkeypatch.setattr(L, "RUN", 200, raising=False)
    monkeypatch.setattr(L, "BLOCK", 16, raising=False)
    got, longest, store = keyed(batches)
    assert got == want and store.timers == whole.timers == set() and store.values["final"] == whole.values["final"]
    assert any(r[-1] for r in got[-2]) and len(got[0]) == len({u for u in batches[0][0].tolist()})
    # held blocks and a block a run at most, or a part of the input; never the whole batch or the whole state
    assert store.most <= 16 and longest <= 150


def test_keyed_state_corrects_the_rows_after_late_readings(spark, tmp_path):
    rng = random.Random(2)
    rows = [(at(m), z, float(rng.choice([0, 3333, 100 + m, 200 + m]))) for m in range(0, 240, 3) for z in ("a", "b")]
    rows += rows[20:24]                                       # seen twice
    # each reading arrives up to 50 minutes after its time
    order = sorted(rows, key=lambda r: r[0] + dt.timedelta(minutes=rng.uniform(0, 50)))
    batches = [order[i:i + 60] for i in range(0, len(order), 60)]
    q, out = run(spark, land(spark, str(tmp_path / "in"), batches), str(tmp_path), "1 hour")
    assert sorted(tuple(r) for r in out.filter(~F.col("late")).select(COLUMNS).collect()) == batch_rows(spark, batches)
    state = [r.state_rows for r in progress_rows(spark, q).orderBy("batch_id").collect()]
    assert len(state) >= len(batches)


def test_rows_beyond_the_delay_are_dropped_and_counted(spark, tmp_path):
    early = [(at(m), "a", 500.0 + m) for m in range(0, 100, 10)]
    later = [(at(1000 + m), "a", 800.0 + m) for m in range(0, 100, 10)]
    last = [(at(2000), "a", 900.0), (at(5), "a", 1.0), (at(15), "a", 2.0)]       # two are some 16 hours late
    stream = observed(land(spark, str(tmp_path / "in"), [early, later, last]), "feed", n=F.count(F.lit(1)), low=F.min("rvr"))
    q, out = run(spark, stream, str(tmp_path), "30 minutes")
    rows = progress_rows(spark, q).orderBy("batch_id").collect()
    assert sum(r.rows_dropped for r in rows) == 2 and sum(r.rows_in for r in rows) == 23
    assert [int(r.observed["feed.n"]) for r in rows if r.rows_in] == [10, 10, 3]
    kept = [early, later, last[:1]]
    assert sorted(tuple(r) for r in out.select(COLUMNS).collect()) == batch_rows(spark, kept)


def lag_table(spark, batches, base, sink=None):
    q = (land(spark, f"{base}/in", batches).writeStream.foreachBatch(sink or J.lag_table_sink(f"{base}/table"))
         .option("checkpointLocation", f"{base}/cp").trigger(**J.ONCE).start())
    q.awaitTermination()
    return sorted(tuple(r) for r in J.lag_rows(spark, f"{base}/table").select(COLUMNS).collect())


def test_lag_table_in_any_order_and_compacted(spark, tmp_path):
    rng = random.Random(4)
    rows = [(at(m), z, float(rng.choice([0, 100 + m % 7, 200 + m]))) for m in range(0, 4 * 1440, 97) for z in ("a", "b", "c")]
    rng.shuffle(rows)
    batches = [rows[i:i + 90] for i in range(0, len(rows), 90)] + [[(at(50), "quiet", 7.0)], [(at(5 * 1440), "quiet", 8.0)], rows[:5]]
    want = batch_rows(spark, batches)
    assert lag_table(spark, batches, str(tmp_path)) == want
    assert J.compact_lags(spark, f"{tmp_path}/table", 10 ** 6) > 0
    assert all(len(J._children(spark, p, "batch_id=")) == 1 for _, p in J._children(spark, f"{tmp_path}/table/lags", "day="))
    assert sorted(tuple(r) for r in J.lag_rows(spark, f"{tmp_path}/table").select(COLUMNS).collect()) == want


def test_a_batch_reads_as_much_after_ten_batches_as_after_two(spark, tmp_path, monkeypatch):
    batches = [[(at(1440 * d + m), z, 100.0 + m) for m in range(0, 1440, 30) for z in ("a", "b")] for d in range(10)]
    read, real = [], J.read_days

    def counted(spark, path, schema, days):
        if path.endswith("lags"):                             # the reader of the result
            return real(spark, path, schema, days)
        read[-1] += sum(os.path.getsize(os.path.join(r, f)) for _, p in days for r, _, fs in os.walk(p) for f in fs if f.endswith(".parquet"))
        return real(spark, path, schema, days)

    sink = J.lag_table_sink(f"{tmp_path}/table")

    def handle(batch, batch_id):
        read.append(0)
        sink(batch, batch_id)

    monkeypatch.setattr(J, "read_days", counted)
    rows = lag_table(spark, batches, str(tmp_path), handle)
    assert rows == batch_rows(spark, batches)
    assert len(read) == 10 and max(read[1:]) <= 1.2 * read[1]


def test_a_failed_cycle_is_run_again_and_the_table_is_the_same(spark, tmp_path):
    batches = [[(at(60 * k + m), "a", 100.0 + m) for m in range(0, 60, 20)] for k in range(3)]
    stream, sink, calls, waits = land(spark, f"{tmp_path}/in", batches), J.lag_table_sink(f"{tmp_path}/table"), [], []

    def handle(batch, batch_id):
        calls.append(batch_id)
        sink(batch, batch_id)
        if batch_id == 1 and calls.count(1) < 3:
            raise RuntimeError("the cycle breaks off after its write")

    def start():
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{tmp_path}/cp").trigger(**J.ONCE).start()

    _, failures = run_supervised(start, retries=3, wait_s=10, sleep=waits.append)
    assert calls == [0, 1, 1, 1, 2] and len(failures) == 2 and waits == [10, 20]
    assert sorted(tuple(r) for r in J.lag_rows(spark, f"{tmp_path}/table").select(COLUMNS).collect()) == batch_rows(spark, batches)
    calls.clear()
    with pytest.raises(StreamingQueryException):
        def broken(batch, batch_id):
            raise RuntimeError("always")
        run_supervised(lambda: stream.writeStream.foreachBatch(broken).option("checkpointLocation", f"{tmp_path}/cp2").trigger(**J.ONCE).start(),
                       retries=2, sleep=waits.append)
    assert len(waits) == 4


def test_the_live_trigger_starts_and_stops(spark, tmp_path):
    stream = land(spark, f"{tmp_path}/in", [[(at(0), "a", 100.0)]])
    q = stream.writeStream.foreachBatch(J.versioned_sink(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/cp").trigger(**J.LIVE).start()
    q.processAllAvailable()
    assert q.isActive and spark.read.parquet(f"{tmp_path}/out").count() == 1
    q.stop()
