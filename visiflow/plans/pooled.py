"""One boosted-tree model for all zones: fit, registry entry, scoring with one transform, forecast by its trees.

A zone enters as numbers fitted on its train rows (mean and deviation of y), so
that the model and its plan do not grow with the number of zones; zones it has
not seen get the average of those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.times import calendar_columns
from visiflow.operators.state import latest_per_key
from visiflow.operators.windows import valid_lag_features
from visiflow.plans.features import FeatureSpec, build_features
from visiflow.plans.scoring import fallback_chain
from visiflow.plans.training import ROWS_PER_PARTITION, load_model, pipeline
from visiflow.session import materialize

#: The registry's zone name of a pooled model, and the numbers that stand for a zone.
ALL_ZONES, CODES = "*", ["zone_mean", "zone_std"]
POOLED_SPEC = FeatureSpec(kind="valid", n_other=0)


@dataclass
class Pooled:
    model: PipelineModel
    codes: DataFrame            # one row a zone
    spec: FeatureSpec


def zone_codes(train: DataFrame) -> DataFrame:
    return train.groupBy("zone").agg(F.avg("y").alias("zone_mean"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("zone_std"))


def with_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows with their zone's numbers; a zone without any takes the averages over zones (scalar subqueries)."""
    j = rows.join(codes, "zone", "left")
    return j.withColumns({c: F.coalesce(F.col(c), codes.select(F.avg(c)).scalar()) for c in CODES})


def fit_pooled(table: DataFrame, spec: FeatureSpec = POOLED_SPEC, params: dict | None = None) -> Pooled:
    """Fit on the train rows of every zone of a training table (zone, ts, y, split, features)."""
    p = dict(C.FIXED_PARAMS) | {"n_estimators": 25} | (params or {})
    train = table.filter(F.col("split") == "train")
    codes = materialize(zone_codes(train))
    rows = with_codes(train, codes).na.fill(0.0, subset=spec.columns())
    rows = rows.coalesce(max(1, -(-train.count() // ROWS_PER_PARTITION))).persist()
    try:
        model = pipeline([*spec.columns(), *CODES], p, int(p.get("seed", 42))).fit(rows)
    finally:
        rows.unpersist()
    return Pooled(model, codes, spec)


def pooled_nowcast(features: DataFrame, pooled: Pooled) -> DataFrame:
    """``predicted`` for the rows of any number of zones: one transform."""
    rows = with_codes(features, pooled.codes).na.fill(0.0, subset=pooled.spec.columns())
    return pooled.model.transform(rows).select(*features.columns, F.col("pred").alias("predicted"))


def save_pooled(spark: SparkSession, pooled: Pooled, base: str) -> DataFrame:
    """Model, codes and the registry entry (zone ``*``) under ``base``; returns the entry."""
    pooled.model.write().overwrite().save(f"{base}/model")
    pooled.codes.write.mode("overwrite").parquet(f"{base}/codes")
    entry = spark.createDataFrame([(ALL_ZONES, base, pooled.spec.to_json())], "zone string, path string, spec string")
    entry.write.mode("overwrite").parquet(f"{base}/registry")
    return spark.read.parquet(f"{base}/registry")


def load_pooled(spark: SparkSession, base: str) -> Pooled:
    entry = spark.read.parquet(f"{base}/registry").first()
    return Pooled(load_model(f"{entry['path']}/model"), spark.read.parquet(f"{entry['path']}/codes"), FeatureSpec.from_json(entry["spec"]))


def score_newest_pooled(bins: DataFrame, pooled: Pooled) -> DataFrame:
    """One row per zone of ``bins``: value and source by the fallback chain from the zone's newest valid state."""
    newest = latest_per_key(build_features(bins, pooled.spec), ["zone"], "ts")
    ready = F.forall(F.array(*[F.col(f"lag_{k}") for k in pooled.spec.lags]), lambda x: x.isNotNull())
    scored = pooled_nowcast(newest, pooled).select("zone", "ts", F.col("y").alias("current"), F.when(ready, F.col("predicted")).alias("predicted"))
    return fallback_chain(bins.select("zone").distinct().join(scored, "zone", "left"))


def tree_forecast(bins: DataFrame, pooled: Pooled, hours: int = C.FORECAST_HOURS, step_min: int = C.FORECAST_STEP_MIN,
                  cut_every: int = 8, value: str = "rvr") -> DataFrame:
    """Multi-step forecast by the pooled trees (M9): zone, step, ts, forecast rounded to one decimal.

    All zones start at the newest time of any zone and take ``hours * 60 / step + 1`` points.  The frame that is
    carried has one row a zone: its last values (the oldest leaves first), its codes and the points so far; its
    lineage is cut every ``cut_every`` steps.  Zones with fewer valid readings than the lags need have no forecast.
    """
    depth = max(pooled.spec.lags) + 1
    lags = [f"lag_{k}" for k in range(1, depth)]
    known = valid_lag_features(bins.select("ts", "zone", value), value, depth=depth)
    start = known.select(F.max("ts")).scalar()
    newest = latest_per_key(known, ["zone"], "ts")
    # the newest value and the ones before it are the lags of the first point
    frame = newest.select("zone", start.alias("start"), F.col(value).alias(lags[0]), *[F.col(a).alias(b) for a, b in zip(lags, lags[1:])])
    frame = frame.dropna(subset=lags).withColumn("path", F.array().cast("array<double>"))
    frame = materialize(with_codes(frame, pooled.codes))
    n = hours * 60 // step_min + 1
    cal = calendar_columns("ts")
    for s in range(n):
        rows = frame.withColumn("ts", F.timestamp_add("MINUTE", F.lit(s * step_min), F.col("start")))
        rows = rows.withColumns({c: cal[c].cast("double") for c in pooled.spec.calendar})
        p = pooled.model.transform(rows)
        moved = [F.col("pred").alias(lags[0]), *[F.col(a).alias(b) for a, b in zip(lags, lags[1:])]]
        frame = p.select("zone", "start", *moved, F.concat("path", F.array("pred")).alias("path"), *CODES)
        if (s + 1) % cut_every == 0:
            frame = materialize(frame)
    out = frame.select("zone", "start", F.posexplode("path").alias("step", "v"))
    return out.select("zone", F.col("step").cast("bigint").alias("step"),
                      F.timestamp_add("MINUTE", F.col("step") * F.lit(step_min), F.col("start")).alias("ts"), F.round("v", 1).alias("forecast"))
