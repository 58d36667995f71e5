"""Registered queries against their DuckDB oracles on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SMALL

from visiflow.plans import catalog

catalog.load_all()
#: Every query of the sensor engine that has SQL beside it.
NAMES = sorted(catalog.ORACLES)


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_every_query_has_docstring():
    from visiflow.plans.catalog import DOCS
    E.queries()
    assert all(DOCS[n] for n in DOCS)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SMALL).toPandas()
    exp = duck.execute(E.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    ec, er = _rows(exp)
    assert gc == ec
    assert len(gr) == len(er)
    assert gr == er


@pytest.mark.parametrize("name", ["stream_valid_lags", "stream_nowcast"])
def test_streams_of_two_overlapping_files_equal_the_sql(spark, duck, tmp_path, monkeypatch, name):
    from pyspark.sql import functions as F
    from visiflow.plans import q_stream
    for part in (1, 0):
        spark.read.parquet(f"{SMALL}/events.parquet").filter(F.col("event_id") % 2 == part).coalesce(1).write.parquet(f"{tmp_path}/p={part}")
    raw = (spark.readStream.schema(q_stream.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.parquet").parquet(str(tmp_path)))
    stream = raw.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("zone"), (F.col("value") * 10.0).alias("rvr"))
    monkeypatch.setattr(q_stream, "readings_stream", lambda *_: stream)
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert _rows(got) == _rows(want)
