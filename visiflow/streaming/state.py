"""Keyed live state: the newest valid readings of every zone.

The only Python function of the engine.  It keeps, per zone, the last
``depth`` valid (time, value) pairs and emits for each new valid reading its
lags over the previous valid readings — the same numbers as the batch
operator ``valid_lag_features``.  Rows older than the zone's newest state
time arrive too late to change lags already emitted; they are emitted with
``late = true`` and do not enter the state.  Where late rows must count, use
``jobs.lag_table_sink``, which corrects the rows after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from visiflow import config as C

OUTPUT_SCHEMA = ("zone string, ts timestamp_ntz, rvr double, lag_1 double, lag_2 double, lag_3 double, "
                 "ready boolean, late boolean")
STATE_SCHEMA = "ts_us array<bigint>, vals array<double>"


def _valid(v: pd.Series, sentinel: float = C.SENTINEL_RVR) -> pd.Series:
    return v.notna() & (v > 0) & (v < sentinel)


def live_state(key, pdfs: Iterator[pd.DataFrame], state, depth: int = C.STATE_DEPTH):
    """One zone of a micro-batch: its newest ``depth`` readings before, its Arrow pieces now (one held at a time)."""
    ts_us, vals = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
    pieces = []
    for pdf in pdfs:
        pdf = pdf[_valid(pdf["rvr"])]
        t = pd.to_datetime(pdf["ts"])
        pieces.append(((t.astype("int64") // 1000 if t.dt.unit == "ns" else t.astype("int64")).to_numpy(), pdf["rvr"].to_numpy()))
    us, v = (np.concatenate(x) if x else np.zeros(0) for x in zip(*pieces)) if pieces else (np.zeros(0, np.int64), np.zeros(0))
    if not len(us):
        return
    # a reading seen again (same zone and time, e.g. a re-read file) does not enter the state twice
    order = np.lexsort((v, us))
    us, v = us[order], v[order]
    once = np.append(True, us[1:] != us[:-1])
    us, v = us[once], v[once]
    late = us < ts_us[-1] if len(ts_us) else np.zeros(len(us), bool)
    fresh = us > ts_us[-1] if len(ts_us) else np.ones(len(us), bool)
    all_us, all_v = np.concatenate([ts_us, us[fresh]]), np.concatenate([vals, v[fresh]])
    held, n = len(vals), int(fresh.sum())
    padded = np.concatenate([np.full(depth, np.nan), all_v])
    at = depth + held + np.arange(n)
    cols = {"zone": key[0], "ts": pd.to_datetime(np.concatenate([us[fresh], us[late]]), unit="us"), "rvr": np.concatenate([v[fresh], v[late]])}
    for k in range(1, depth):
        cols[f"lag_{k}"] = np.concatenate([padded[at - k], np.full(int(late.sum()), np.nan)])
    cols["ready"] = np.concatenate([held + np.arange(n) >= depth - 1, np.zeros(int(late.sum()), bool)])
    cols["late"] = np.repeat([False, True], [n, int(late.sum())])
    state.update((all_us[-depth:].tolist(), all_v[-depth:].tolist()))
    yield pd.DataFrame(cols)
