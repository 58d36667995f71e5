"""Timestamp parsing, calendar features and time grids.

Timestamps are kept as TIMESTAMP_NTZ (naive wall clock) so results do not
depend on the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from visiflow import config as C



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c, formats=C.CSV_TS_FORMATS) -> Column:
    """Row-level multi-format parse: first format that parses wins, else NULL."""
    s = F.trim(_col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse_date_time(date_col, time_col, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Separate date and time text columns joined with a blank, then parsed."""
    s = F.concat_ws(" ", F.trim(_col(date_col).cast("string")), F.trim(_col(time_col).cast("string")))
    return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")


def epoch_us(c) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp (time-zone free)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), _col(c).cast("timestamp_ntz"))


def from_epoch_us(c) -> Column:
    return F.timestamp_add("MICROSECOND", _col(c), _epoch())


def floor_minutes(c, minutes: int = C.BIN_MINUTES) -> Column:
    """Floor to a fixed bin width (tumbling window start)."""
    return F.window(_col(c).cast("timestamp_ntz"), f"{minutes} minutes").start


def calendar_columns(c) -> dict[str, Column]:
    """hour, day_of_week (Monday=0), month, day_of_year, year as BIGINT."""
    t = _col(c)
    return {
        "hour": F.hour(t).cast("bigint"),
        "day_of_week": F.weekday(t).cast("bigint"),
        "month": F.month(t).cast("bigint"),
        "day_of_year": F.dayofyear(t).cast("bigint"),
        "year": F.year(t).cast("bigint"),
    }


def cyclic_columns(c) -> dict[str, Column]:
    """sin/cos encodings of hour/24 and month/12."""
    t = _col(c)
    h = F.hour(t).cast("double")
    m = F.month(t).cast("double")
    two_pi = 2.0 * math.pi
    return {
        "hour_sin": F.sin(F.lit(two_pi) * h / 24.0),
        "hour_cos": F.cos(F.lit(two_pi) * h / 24.0),
        "month_sin": F.sin(F.lit(two_pi) * m / 12.0),
        "month_cos": F.cos(F.lit(two_pi) * m / 12.0),
    }


def season(c, seasons=C.SEASONS) -> Column:
    m = F.month(_col(c))
    expr = None
    for name, months in seasons:
        expr = F.when(m.isin(months), F.lit(name)) if expr is None else expr.when(m.isin(months), F.lit(name))
    return expr


def format_ts(c, fmt: str = C.OUTPUT_TS_FORMAT) -> Column:
    return F.date_format(_col(c), fmt)


def time_grid(start, hours: int = C.FORECAST_HOURS, step_min: int = C.FORECAST_STEP_MIN) -> Column:
    """Array of timestamps start, start+step, ... start+hours (inclusive)."""
    s = _col(start).cast("timestamp_ntz")
    n = hours * 60 // step_min
    return F.transform(F.sequence(F.lit(0), F.lit(n)),
                       lambda i: F.timestamp_add("MINUTE", i * step_min, s))
