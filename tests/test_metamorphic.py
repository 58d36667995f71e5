"""Properties: distributed formulations equal brute force on small inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from visiflow.operators.asof import asof_join
from visiflow.operators.binning import bin_mean
from visiflow.operators.index import dense_index, time_chunk
from visiflow.operators.prep import exact_quantiles

from conftest import MEDIUM


def _readings(spark, sf=MEDIUM):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("ts"), F.col("event_type").alias("zone"), (F.col("value") * 10).alias("rvr"))


def test_dense_index_equals_row_number(spark):
    r = _readings(spark)
    a = dense_index(r, ["zone"], ["ts"], time_chunk("ts", 3_600_000_000), "i")
    b = r.withColumn("i", (F.row_number().over(Window.partitionBy("zone").orderBy("ts")) - 1).cast("bigint"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_asof_nearest_matches_pandas(spark):
    b = bin_mean(_readings(spark)).select("ts", "zone", "rvr")
    left = b.filter(F.col("zone") == "click").select("ts", "rvr")
    right = b.filter(F.col("zone") == "view").select("ts", F.col("rvr").alias("v"))
    got = asof_join(left, right, "ts", tolerance_minutes=30).toPandas().sort_values("ts").reset_index(drop=True)
    lp = left.toPandas().sort_values("ts")
    rp = right.toPandas().sort_values("ts").rename(columns={"v": "right_v"})
    exp = pd.merge_asof(lp, rp, on="ts", direction="nearest", tolerance=pd.Timedelta("30min"))
    assert len(got) == len(exp)
    assert got["right_v"].isna().sum() == exp["right_v"].isna().sum()
    assert np.isclose(got["right_v"].fillna(0).sum(), exp["right_v"].fillna(0).sum())


def test_asof_backward_by_key_matches_pandas(spark):
    r = _readings(spark)
    b = bin_mean(r).select("ts", "zone", "rvr")
    got = asof_join(b, r.withColumnRenamed("rvr", "v"), "ts", by=["zone"], direction="backward").toPandas()
    exp = pd.merge_asof(b.toPandas().sort_values("ts"), r.withColumnRenamed("rvr", "v").toPandas().sort_values("ts")
                        .rename(columns={"v": "right_v"}), on="ts", by="zone", direction="backward")
    assert len(got) == len(exp)
    assert np.isclose(got["right_v"].fillna(0).sum(), exp["right_v"].fillna(0).sum())


def test_exact_quantiles_match_numpy(spark):
    b = bin_mean(_readings(spark)).select("zone", "rvr")
    q = {r.zone: (r.q_25, r.q_50, r.q_75) for r in exact_quantiles(b, "rvr", [0.25, 0.5, 0.75], ["zone"]).collect()}
    pdf = b.toPandas()
    for z, g in pdf.groupby("zone"):
        exp = np.quantile(g["rvr"].to_numpy(), [0.25, 0.5, 0.75])
        assert np.allclose(q[z], exp)


def test_repartition_invariance(spark):
    from visiflow.operators.windows import lag_features
    b = bin_mean(_readings(spark)).select("ts", "zone", "rvr")
    a = lag_features(b)
    c = lag_features(b.repartition(13))
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_exact_quantiles_with_hot_value(spark):
    rows = [("a", 1000.0)] * 300 + [("a", float(i)) for i in range(600)] + [("b", float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "zone string, rvr double")
    got = {r.zone: (r.q_25, r.q_50, r.q_75) for r in exact_quantiles(df, "rvr", [0.25, 0.5, 0.75], ["zone"]).collect()}
    pdf = df.toPandas()
    for z, g in pdf.groupby("zone"):
        assert np.allclose(got[z], np.quantile(g["rvr"].to_numpy(), [0.25, 0.5, 0.75]))
