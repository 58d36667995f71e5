"""The second training pipeline: readings joined with the nearest weather, weather and cyclic features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.times import calendar_columns, cyclic_columns
from visiflow.functions.values import finite
from visiflow.functions.weather import dew_point_spread, temp_humidity_ratio
from visiflow.operators.asof import asof_join
from visiflow.operators.index import with_positions
from visiflow.operators.prep import impute_median
from visiflow.operators.state import min_sample_gate
from visiflow.operators.windows import grid_features, temporal_split
from visiflow.operators.metrics import regression_metrics
from visiflow.plans.training import pipeline, zone_rows
from visiflow.session import materialize

RUN_A = ("zone string, method string, epoch bigint, n_train bigint, n_test bigint, train_rmse double, test_rmse double, "
         "train_r2 double, test_r2 double, train_mae double, test_mae double, features string")
MEASURES = ["temperature", "humidity", "wind_speed", "dew_point"]
FEATURES = (["hour", "day_of_week", "month", "year", "day_of_year", "hour_sin", "hour_cos", "month_sin", "month_cos"]
            + [f"lag_{k}" for k in C.LAGS] + ["rolling_3", "rolling_6"] + MEASURES + ["temp_humidity_ratio", "temp_dewpoint_diff"])


def canonical_weather(df: DataFrame) -> DataFrame:
    """Weather columns under the pipeline's short names; those already named so stay."""
    return df.withColumnsRenamed({old: new for old, new in C.PIPELINE_A_WEATHER.items() if old in df.columns})


def pipeline_a_features(bins: DataFrame, weather: DataFrame, include_current: bool = False) -> DataFrame:
    """zone, ts, y and FEATURES of every bin whose three lags exist.

    Weather is that of the nearest time within 30 minutes (NULL beyond).  The
    rolling means take whatever of their 3 or 6 positions holds a value; with
    ``include_current`` they end at the row itself, as in the source system,
    otherwise one position before it.
    """
    cells = with_positions(bins.select("ts", "zone", "rvr"))
    f = grid_features(cells, lags=C.LAGS, strict_windows=(), lenient_windows=(3, 6), include_current=include_current)
    f = f.dropna(subset=[f"lag_{k}" for k in C.LAGS])
    f = asof_join(f, weather.select("ts", *MEASURES), "ts", tolerance_minutes=C.ASOF_TOLERANCE_MIN, direction="nearest", prefix="w_")
    f = f.withColumnsRenamed({f"w_{m}": m for m in MEASURES})
    f = f.withColumns({**calendar_columns("ts"), **cyclic_columns("ts"),
                       "rolling_3": F.col("roll_mean_3_lenient"), "rolling_6": F.col("roll_mean_6_lenient"),
                       "temp_humidity_ratio": temp_humidity_ratio("temperature", "humidity"),
                       "temp_dewpoint_diff": dew_point_spread("temperature", "dew_point")})
    return f.select("zone", "ts", F.col("rvr").alias("y"), *FEATURES)


def pipeline_a_table(features: DataFrame, path: str, min_samples: int = C.MIN_SAMPLES) -> DataFrame:
    """The second pipeline's training table: 80/20 by time per zone, medians of the train rows, written by zone."""
    spark = features.sparkSession
    split = materialize(temporal_split(features.filter(finite(F.col("y"))), ["zone"], "ts"))
    # year and the like are whole numbers; every feature is read as a double
    split = split.withColumns({c: F.col(c).cast("double") for c in FEATURES})
    done = impute_median(split, FEATURES, ["zone"], fit_on=split.filter(F.col("split") == "train"))
    kept = min_sample_gate(done, ["zone"], min_samples)
    kept.write.mode("overwrite").partitionBy("zone").parquet(path)
    return spark.read.schema(kept.schema).parquet(path)      # no zone may have enough rows


def train_pipeline_a(spark: SparkSession, table: DataFrame, workers: int = 8) -> DataFrame:
    """One fixed run of ``PIPELINE_A_PARAMS`` per zone (M2): the run log, with the features each zone has values of."""
    counts = table.filter(F.col("split") == "train").groupBy("zone").agg(*[F.count(c).alias(c) for c in FEATURES]).collect()
    usable = {r["zone"]: [c for c in FEATURES if r[c]] for r in counts}
    rows = {z: zone_rows(table, z, f) for z, f in usable.items()}

    def run(zone):
        model = pipeline(usable[zone], C.PIPELINE_A_PARAMS, C.PIPELINE_A_PARAMS["seed"]).fit(rows[zone].filter(F.col("split") == "train"))
        m = {r["split"]: r for r in regression_metrics(model.transform(rows[zone]), ["split"], "y", "pred").collect()}
        return (zone, "pipeline_a", C.PIPELINE_A_PARAMS["n_estimators"], *(m[s][k] for k in ("n", "rmse", "r2", "mae") for s in ("train", "test")),
                ",".join(usable[zone]))

    try:
        with ThreadPoolExecutor(max_workers=workers) as ex:
            log = list(ex.map(run, sorted(rows)))
    finally:
        for z in rows.values():
            z.unpersist()
    return spark.createDataFrame(log, RUN_A)
