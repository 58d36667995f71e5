"""The update cycle: train, register, load, score every zone, fall back, write history and latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.operators.binning import bin_mean
from visiflow.operators.state import latest_per_key
from visiflow.plans.features import FeatureSpec, build_features
from visiflow.plans.scoring import fallback_chain, model_nowcast
from visiflow.plans.training import load_model, save_models, train_all, training_table, zones_by_model
from visiflow.session import materialize
from visiflow.sources.sinks import append_history, append_training_log, write_latest

#: The live state's features: lags over a zone's valid bins, and the calendar.
LIVE_SPEC = FeatureSpec(kind="valid", n_other=0)


def train_and_register(spark: SparkSession, bins: DataFrame, base: str, tree_counts=C.FIXED_TREE_COUNTS,
                       spec: FeatureSpec = LIVE_SPEC) -> DataFrame:
    """Fit every zone with enough rows, keep its best run, save models, registry and run log under ``base``."""
    table = training_table(bins, spec)
    zones = sorted(r["zone"] for r in table.select("zone").distinct().collect())
    log, best = train_all(spark, table, zones, spec, tree_counts=tree_counts, tune=False)
    append_training_log(log, f"{base}/training-log")
    save_models(spark, best, f"{base}/models", spec).write.mode("overwrite").parquet(f"{base}/registry")
    return spark.read.parquet(f"{base}/registry")


def score_newest(bins: DataFrame, registry: DataFrame, spec: FeatureSpec = LIVE_SPEC) -> DataFrame:
    """One row per zone of ``bins``: value and source by the fallback chain from the zone's newest valid state."""
    rows = build_features(bins, spec)
    newest = materialize(latest_per_key(rows, ["zone"], "ts"))        # read once per model
    ready = F.forall(F.array(*[F.col(f"lag_{k}") for k in spec.lags]), lambda x: x.isNotNull())
    models = {r["zone"]: load_model(r["path"]) for r in registry.collect()}        # one row a zone
    known, _ = zones_by_model(newest.filter(ready), registry)
    scored = model_nowcast(known, models).select("zone", "predicted")
    out = bins.select("zone").distinct().join(newest.select("zone", "ts", F.col("y").alias("current")), "zone", "left")
    return fallback_chain(out.join(scored, "zone", "left"))


def live_cycle(spark: SparkSession, readings: DataFrame, base: str, tree_counts=C.FIXED_TREE_COUNTS) -> DataFrame:
    """One whole cycle; returns the latest table as written."""
    bins = materialize(bin_mean(readings).select("ts", "zone", "rvr"))
    registry = train_and_register(spark, bins, base, tree_counts)
    scored = materialize(score_newest(bins, registry))                # written to the history and to the latest table
    append_history(scored, f"{base}/history")
    write_latest(scored, f"{base}/latest", mode="copy")
    return spark.read.parquet(f"{base}/latest")
