"""Column expressions on sensor values (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visiflow import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_value(c) -> Column:
    """Numeric coercion: blank / '-' / text -> NULL, NaN and +-inf -> NULL."""
    c = _col(c)
    s = F.trim(c.cast("string"))
    v = F.when(s.isin("", "-"), F.lit(None).cast("double")).otherwise(s.try_cast("double"))
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(v)


def is_valid(c, sentinel: float = C.SENTINEL_RVR) -> Column:
    """Valid reading: present and strictly between 0 and the off-scale sentinel."""
    v = _col(c)
    return F.coalesce((v > 0) & (v < F.lit(sentinel)), F.lit(False))


def current_value(c, sentinel: float = C.SENTINEL_RVR, default: float = C.DEFAULT_RVR) -> Column:
    """'Current' column: null or sentinel -> default, anything else kept."""
    v = _col(c)
    return F.when(v.isNull() | (v == F.lit(sentinel)), F.lit(float(default))).otherwise(v.cast("double"))


def default_fill(c, default: float = C.DEFAULT_RVR) -> Column:
    return F.coalesce(_col(c).cast("double"), F.lit(float(default)))


def status_band(c, bands=C.STATUS_BANDS, fallback=C.STATUS_FALLBACK) -> Column:
    """Status label; thresholds are lower bounds, tested highest first."""
    v = _col(c)
    expr = None
    for lo, status, _ in bands:
        expr = F.when(v >= lo, F.lit(status)) if expr is None else expr.when(v >= lo, F.lit(status))
    return expr.otherwise(F.lit(fallback[0]))


def status_color(c, bands=C.STATUS_BANDS, fallback=C.STATUS_FALLBACK) -> Column:
    v = _col(c)
    expr = None
    for lo, _, color in bands:
        expr = F.when(v >= lo, F.lit(color)) if expr is None else expr.when(v >= lo, F.lit(color))
    return expr.otherwise(F.lit(fallback[1]))


def finite(c) -> Column:
    """Not null, not NaN, not infinite."""
    v = _col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
