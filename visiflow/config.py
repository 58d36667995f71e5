"""Fixed values of the domain.

Everything in this module is data, not logic: sensor zone names, runway
geometry, status thresholds, parser formats and search grids that the
results must agree with.  They are kept together so that a deployment can
override them in one place (every operator takes them as parameters with
these values as defaults).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source system's for matching results)
# ---------------------------------------------------------------------------

# Sensor zones modelled, in the source system's listing order.
ZONES = [
    "RWY 09 (BEG)", "RWY 09 (TDZ)",
    "RWY 10 (TDZ)",
    "RWY 11 (BEG)", "RWY 11 (TDZ)",
    "RWY 27 (MID)",
    "RWY 28 (BEG)", "RWY 28 (MID)", "RWY 28 (TDZ)",
    "RWY 29 (BEG)", "RWY 29 (MID)",
]

# Off-scale sentinel and the value used wherever no reading exists (metres).
SENTINEL_RVR = 3333.0
DEFAULT_RVR = 1000.0

# Status bands: (lower bound inclusive, status, colour), highest first;
# anything below the last bound is the final fallback band.
STATUS_BANDS = [
    (800.0, "Good", "green"),
    (500.0, "Moderate", "orange"),
    (200.0, "Poor", "red"),
]
STATUS_FALLBACK = ("Very Poor", "darkred")

# Runway dimension: runway -> begin (lat, lon), heading (degrees), length (m).
RUNWAYS = [
    ("11", 28.546269726812046, 77.07209263473048, 103.0, 4430),
    ("29", 28.538300748490773, 77.1068818248323, 283.0, 4430),
    ("10", 28.567182331326887, 77.08498547442058, 104.4, 3813),
    ("28", 28.558606400571975, 77.12240587666396, 284.4, 3813),
    ("09", 28.570559706309265, 77.08822392522595, 91.4, 2816),
    ("27", 28.569910389750675, 77.11687357828113, 271.4, 2816),
]
# Touch-down zone point distance from the runway begin (m); MID is length/2.
TDZ_DISTANCE_M = 300.0

# Display zone -> zone id whose prediction stands in for it on the map.
ZONE_PROXY = [
    ("RWY_09_TDZ", "RWY_09_TDZ"),
    ("RWY_09_MID", "RWY_09_BEG"),
    ("RWY_10_TDZ", "RWY_10_TDZ"),
    ("RWY_10_MID", "RWY_10_TDZ"),
    ("RWY_11_TDZ", "RWY_11_TDZ"),
    ("RWY_11_MID", "RWY_11_BEG"),
    ("RWY_27_TDZ", "RWY_27_MID"),
    ("RWY_27_MID", "RWY_27_MID"),
    ("RWY_28_TDZ", "RWY_28_TDZ"),
    ("RWY_28_MID", "RWY_28_MID"),
    ("RWY_29_TDZ", "RWY_29_BEG"),
    ("RWY_29_MID", "RWY_29_MID"),
]

# Raw log line: date, time, then tab separated "<zone> <value>" parts.
LOG_LINE_PATTERN = r"^(\d{2}-\d{2}-\d{4})\t(\d{2}:\d{2}:\d{2})\t(.+)$"
LOG_TS_FORMAT = "dd-MM-yyyy HH:mm:ss"

# Timestamp formats tried in order (training CSV reader, live reader).
CSV_TS_FORMATS = ["dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
LIVE_TS_FORMATS = ["yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm"]
OUTPUT_TS_FORMAT = "yyyy-MM-dd HH:mm"

# Weather feed columns as delivered by the cleaner.
WEATHER_COLUMNS = [
    "Date", "Time",
    "Temperature1MinAvg (DEG C)",
    "DewPoint1MinAvg (DEG C)",
    "Humidity1MinAvg (%Rh)",
    "Pressure1MinAvg (mBar)",
    "QNH1MinAvg (mBar)",
    "QFE1MinAvg (mBar)",
    "Wind Direction Inst. (DEG)",
    "Wind Speed Inst. (knots)",
]
# Canonical short names for the measures above (same order, Date/Time dropped).
WEATHER_CANONICAL = [
    "temperature", "dew_point", "humidity", "pressure",
    "qnh", "qfe", "wind_dir", "wind_speed",
]
# Runway codes the weather cleaner folds variants into.
WEATHER_RUNWAY_CODES = ["28", "29", "11"]

# Feature construction.
LAGS = [1, 2, 3]
ROLL_WINDOWS = [3, 6, 12]
MAX_OTHER_ZONES = 5
BIN_MINUTES = 10
ASOF_TOLERANCE_MIN = 30
STATE_DEPTH = 4            # readings kept per zone by the live scorer
TAIL_ROWS = 100            # rows searched back for a valid reading
HORIZON_HOURS = 12
TRAIN_FRACTION = 0.8
CV_FOLDS = 3
MIN_SAMPLES = 100
R2_TARGET = 0.9923
R2_GOOD = 0.99

# Model search space and fixed runs.
FIXED_TREE_COUNTS = [10, 25, 20]
FIXED_PARAMS = dict(max_depth=6, learning_rate=0.1, subsample=0.8, colsample_bytree=0.8, seed=42)
PARAM_GRID = {
    "n_estimators": [50, 100, 200, 300],
    "max_depth": [4, 6, 8, 10],
    "learning_rate": [0.05, 0.1, 0.15, 0.2],
    "subsample": [0.8, 0.9, 1.0],
    "colsample_bytree": [0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5],
    "gamma": [0, 0.1, 0.2],
}
SEARCH_DRAWS = 50
# Second training pipeline's fixed model (as-of weather features).
PIPELINE_A_PARAMS = dict(n_estimators=200, learning_rate=0.05, max_depth=6, subsample=0.8, colsample_bytree=0.8, seed=42)
# Weather columns by the second pipeline's own names.
PIPELINE_A_WEATHER = {
    "Temperature1MinAvg (DEG C)": "temperature",
    "Humidity1MinAvg (%)": "humidity",
    "Wind Speed": "wind_speed",
    "DewPoint1MinAvg (DEG C)": "dew_point",
}
FORECAST_STEP_MIN = 15
UPDATE_SECONDS = 60
RETRY_SECONDS = 10          # wait after a failed update cycle
FORECAST_HOURS = 24

# Seasons by month (documented-only feature).
SEASONS = [
    ("winter", [12, 1, 2]),
    ("spring", [3, 4, 5]),
    ("monsoon", [6, 7, 8, 9]),
    ("autumn", [10, 11]),
]
