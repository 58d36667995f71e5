"""Scoring: nowcasts, fallback chain, range backfill, multi-step forecasts.

The live scorer's state (last four valid readings per zone) is the same
thing as the valid-reading lags of ``valid_lag_features``; batch scoring
uses that operator and streaming keeps the state explicitly
(``streaming.state``).  Both feed the same predictor functions here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.times import time_grid
from visiflow.functions.values import current_value, is_valid
from visiflow.operators.asof import asof_join
from visiflow.operators.joins import union_feeds
from visiflow.operators.state import latest_per_key
from visiflow.operators.windows import last_n, valid_lag_features
from visiflow.plans.features import FeatureSpec, build_features
from visiflow.session import materialize


# ---------------------------------------------------------------------------
# predictors
# ---------------------------------------------------------------------------

def fit_linear_nowcast(state_rows: DataFrame, keys=("zone",), y: str = "rvr", x: str = "lag_1") -> DataFrame:
    """Per-zone least squares y = a + b * lag_1 over rows whose lag exists (closed form)."""
    rows = state_rows.filter(F.col(x).isNotNull())
    return rows.groupBy(*keys).agg(F.regr_intercept(F.col(y), F.col(x)).alias("a"),
                                   F.regr_slope(F.col(y), F.col(x)).alias("b"))


def linear_nowcast(features: DataFrame, coefs: DataFrame, keys=("zone",), x: str = "lag_1",
                   ready: str = "ready") -> DataFrame:
    """``predicted`` = a + b * lag_1 where the state is ready and a model exists, else NULL."""
    j = features.join(coefs, list(keys), "left")
    pred = F.when(F.col(ready) & F.col("a").isNotNull() & F.col("b").isNotNull(),
                  F.col("a") + F.col("b") * F.col(x))
    return j.withColumn("predicted", pred).drop("a", "b")


def model_nowcast(features: DataFrame, models: Mapping[str, PipelineModel], keys=("zone",)) -> DataFrame:
    """Score each zone's rows with its own model (M6); zones without a model get NULL.

    The loop is over the model registry (one entry per zone); each transform
    is a distributed job and the results are unioned.
    """
    parts = []
    for zone, model in models.items():
        z = features.filter(F.col(keys[0]) == zone)
        parts.append(model.transform(z).select(*features.columns, F.col("pred").alias("predicted")))
    known = list(models)
    rest = features.filter(~F.col(keys[0]).isin(known)).withColumn("predicted", F.lit(None).cast("double"))
    return union_feeds(parts + [rest]) if parts else rest


def fallback_chain(df: DataFrame, predicted: str = "predicted", current: str = "current",
                   default: float = C.DEFAULT_RVR) -> DataFrame:
    """Model -> current valid reading -> default, with the source of the value (M7)."""
    value = F.coalesce(F.col(predicted), F.col(current), F.lit(float(default)))
    source = (F.when(F.col(predicted).isNotNull(), F.lit("model"))
              .when(F.col(current).isNotNull(), F.lit("current")).otherwise(F.lit("default")))
    return df.withColumn("value", value).withColumn("source", source)


# ---------------------------------------------------------------------------
# jobs
# ---------------------------------------------------------------------------

def range_backfill(bins: DataFrame, start, end, coefs: DataFrame | None = None, value: str = "rvr",
                   depth: int = C.STATE_DEPTH, state: DataFrame | None = None) -> DataFrame:
    """Nowcast every bin of [start, end] (inclusive) from the state as of that bin (M8).

    The state of a (zone, time) is the newest ``depth`` valid bins at or
    before it — a backward as-of join against the valid-lag table, so a
    step never sees readings after its own time.  ``current`` is the newest
    valid value in that state, ``raw_current`` the bin's own value by the
    looser 'current' rule.  Without given coefficients the fit uses the
    state rows before ``start`` only, so no step depends on later rows (a
    zone without any gets no model and falls back).  A state table computed
    by the caller can be passed as ``state``.
    """
    bins = bins.filter(F.col("ts") <= end)
    if state is None:
        state = valid_lag_features(bins.select("ts", "zone", value), value, depth=depth)
        if coefs is None:
            state = materialize(state)          # read by the fit and by the as-of join
    if coefs is None:
        coefs = fit_linear_nowcast(state.filter(F.col("ts") < start))
    steps = bins.filter(F.col("ts").between(start, end)).select("ts", "zone", F.col(value).alias("raw"))
    st = state.select("zone", "ts", F.col(value).alias("v"), *[f"lag_{k}" for k in range(1, depth)], "ready")
    j = asof_join(steps, st, "ts", by=["zone"], tolerance_minutes=None, direction="backward", prefix="s_")
    j = j.select("ts", "zone", "raw", F.col("s_v").alias("current"), F.col("s_lag_1").alias("lag_1"),
                 F.coalesce(F.col("s_ready"), F.lit(False)).alias("ready"))
    scored = linear_nowcast(j, coefs)
    return fallback_chain(scored).withColumn("raw_current", current_value(F.col("raw")))


def latest_nowcast(bins: DataFrame, coefs: DataFrame | None = None, value: str = "rvr",
                   depth: int = C.STATE_DEPTH) -> DataFrame:
    """One row per zone: nowcast from the newest state, with the fallback chain (M6 + M7 + J7).

    Without given coefficients, the fit and the newest state come out of a
    single aggregation over the state table (regr_* skip rows without a lag).
    """
    state = valid_lag_features(bins.select("ts", "zone", value), value, depth=depth)
    newest = [F.max("ts").alias("ts"), F.max_by(F.col(value), "ts").alias("current"),
              F.max_by("lag_1", "ts").alias("lag_1"), F.max_by("ready", "ts").alias("ready")]
    if coefs is None:
        last = state.groupBy("zone").agg(F.regr_intercept(F.col(value), F.col("lag_1")).alias("a"),
                                         F.regr_slope(F.col(value), F.col("lag_1")).alias("b"), *newest)
    else:
        last = state.groupBy("zone").agg(*newest).join(coefs, "zone", "left")
    zones = bins.select("zone").distinct()
    j = zones.join(last, "zone", "left").withColumn("ready", F.coalesce(F.col("ready"), F.lit(False)))
    pred = F.when(F.col("ready") & F.col("a").isNotNull() & F.col("b").isNotNull(),
                  F.col("a") + F.col("b") * F.col("lag_1"))
    return fallback_chain(j.withColumn("predicted", pred).drop("a", "b"))


def linear_ar_forecast(bins: DataFrame, coefs: DataFrame, hours: int = C.FORECAST_HOURS,
                       step_min: int = C.FORECAST_STEP_MIN, value: str = "rvr") -> DataFrame:
    """Multi-step AR(1) forecast per zone in one expression (M9 + F8).

    All zones share one start, the newest time of any zone; ``hours * 60 /
    step + 1`` points are produced; point i is a + b * point(i-1), point(-1)
    being the zone's own newest value.  ``aggregate`` over the step sequence carries the state, so no
    driver loop or per-step job is needed.
    """
    known = bins.filter(F.col(value).isNotNull()).select("zone", "ts", value)
    last = latest_per_key(known, ["zone"]).withColumn("ts", known.select(F.max("ts")).scalar())
    j = last.join(coefs, "zone")
    n = hours * 60 // step_min + 1
    vals = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array().cast("array<double>"),
                       lambda acc, i: F.concat(acc, F.array(
                           F.col("a") + F.col("b") * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.col(value)))))
    j = j.withColumn("_grid", time_grid(F.col("ts"), hours, step_min)).withColumn("_vals", vals)
    z = j.select("zone", F.posexplode(F.arrays_zip(F.col("_grid").alias("t"), F.col("_vals").alias("v"))))
    return z.select("zone", F.col("pos").cast("bigint").alias("step"), F.col("col.t").alias("ts"),
                    F.round(F.col("col.v"), 1).alias("forecast"))


def model_forecast(bins: DataFrame, models: Mapping[str, PipelineModel], spec: FeatureSpec, steps: int,
                   step_min: int = C.BIN_MINUTES, value: str = "rvr", checkpoint_every: int = 8) -> DataFrame:
    """Recursive multi-step forecast with fitted models (M9, non-linear case).

    Each step appends the previous step's prediction as a new bin and
    rebuilds features with the same ``FeatureSpec``, so lags and calendar
    fields move with the forecast time (lags shift oldest first).  The
    loop is bounded by ``steps``; the frame it carries is one row per zone
    per step, and its lineage is cut with a reliable ``checkpoint()`` every
    ``checkpoint_every`` steps.
    """
    if spec.kind == "grid" and spec.include_current:
        raise ValueError("forecast features must not include the current row (include_current=False)")
    if spec.kind == "grid" and spec.n_other and not spec.cross_zone_lag:
        raise ValueError("other zones are not known at the forecast time (cross_zone_lag=1)")
    # only the look-back the features need travels through the loop
    depth = max(list(spec.lags) + list(spec.windows)) + 1
    hist = last_n(bins.select("ts", "zone", value), depth, ["zone"]).drop("rank_from_end")
    out = None
    for s in range(steps):
        newest = latest_per_key(hist.select("zone", "ts"), ["zone"]).select(
            "zone", F.timestamp_add("MINUTE", F.lit(step_min), F.col("ts")).alias("next_ts"))
        # the next time is appended without a value on the grid; the valid-reading
        # features number valid rows only, so there it needs one, which no feature
        # reads (lags are the zone's own earlier rows)
        hold = F.lit(1.0 if spec.kind == "valid" else None).cast("double")
        nxt = newest.select(F.col("next_ts").alias("ts"), "zone", hold.alias(value))
        feats = build_features(hist.unionByName(nxt), spec, value).join(
            newest.withColumnRenamed("next_ts", "ts"), ["zone", "ts"], "left_semi")
        # a feature without any value at a forecast step (e.g. no other zone at that time) is 0
        feats = feats.na.fill(0.0, subset=spec.columns())
        scored = model_nowcast(feats, models).select("zone", "ts", F.col("predicted").alias(value))
        step = scored.withColumn("step", F.lit(s))
        out = step if out is None else out.unionByName(step)
        hist = hist.unionByName(scored.select("ts", "zone", value))
        if (s + 1) % checkpoint_every == 0:
            hist = materialize(hist)
            out = materialize(out)
    return out


def prediction_record(scored: DataFrame, zones: list[str]) -> DataFrame:
    """Wide prediction record per time: <zone>_predicted and <zone>_current (defaults 1000)."""
    p = scored.groupBy("ts").pivot("zone_id", zones).agg(F.first("value").alias("predicted"),
                                                          F.first("raw_current").alias("current"))
    ren = {}
    for z in zones:
        ren[f"{z}_predicted"] = F.coalesce(F.col(f"`{z}_predicted`"), F.lit(C.DEFAULT_RVR))
        ren[f"{z}_current"] = F.coalesce(F.col(f"`{z}_current`"), F.lit(C.DEFAULT_RVR))
    return p.select("ts", *[v.alias(k) for k, v in ren.items()])


def system_status(predictions: DataFrame, registry: DataFrame, readings: DataFrame) -> DataFrame:
    """Last update, predictions kept, models available, zones with data (A15), one row."""
    p = predictions.agg(F.max("ts").alias("last_update"), F.count(F.lit(1)).cast("bigint").alias("predictions_kept"))
    # the other figures are scalar subqueries (one value each), not joins
    m = registry.agg(F.count_distinct("zone").cast("bigint")).scalar()
    f = readings.agg(F.count_distinct("zone").cast("bigint")).scalar()
    v = readings.agg(F.count_if(is_valid(F.col("rvr"))).cast("bigint")).scalar()
    return p.select("*", m.alias("models_available"), f.alias("feeds_available"), v.alias("valid_readings"))
