"""Weather-derived feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def temp_humidity_ratio(temp, humidity) -> Column:
    return _col(temp) / (_col(humidity) + F.lit(1e-6))


def dew_point_spread(temp, dew_point) -> Column:
    return _col(temp) - _col(dew_point)


def wind_components(speed, direction) -> tuple[Column, Column]:
    """(u, v) = speed * (sin, cos) of the direction in degrees."""
    rad = F.radians(_col(direction))
    return _col(speed) * F.sin(rad), _col(speed) * F.cos(rad)


def relative_humidity(temp, dew_point) -> Column:
    """Magnus formula relative humidity (%) from temperature and dew point (deg C)."""
    a, b = 17.625, 243.04
    t, d = _col(temp), _col(dew_point)
    return F.lit(100.0) * F.exp(F.lit(a) * d / (F.lit(b) + d)) / F.exp(F.lit(a) * t / (F.lit(b) + t))
