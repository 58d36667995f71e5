"""Zone and runway name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visiflow import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_log_zone(c) -> Column:
    """Upper-case, RUNWAY -> RWY, trim; L/R suffixes are kept."""
    return F.trim(F.regexp_replace(F.upper(_col(c)), "RUNWAY", "RWY"))


def normalize_weather_runway(c, codes=C.WEATHER_RUNWAY_CODES) -> Column:
    """Upper-case without '-', folded to RUNWAYnn when it names a known runway.

    Names that match no known code are returned unchanged (original text).
    """
    raw = _col(c)
    u = F.regexp_replace(F.upper(raw), "-", "")
    expr = None
    for code in codes:
        cond = u.contains(f"RUNWAY{code}")
        expr = F.when(cond, F.lit(f"RUNWAY{code}")) if expr is None else expr.when(cond, F.lit(f"RUNWAY{code}"))
    return expr.otherwise(raw)


def safe_zone(c) -> Column:
    """'RWY 09 (BEG)' -> 'RWY_09_BEG'."""
    s = F.regexp_replace(_col(c), " ", "_")
    return F.regexp_replace(s, r"[()]", "")


def zone_from_safe(c) -> Column:
    """'RWY_09_BEG' -> 'RWY 09 (BEG)' (inverse of safe_zone for RWY_nn_PART ids)."""
    return F.regexp_replace(_col(c), r"^(\w+?)_(\w+?)_(\w+)$", "$1 $2 ($3)")


def runway_of_zone(c) -> Column:
    """Runway number of a zone id or name ('RWY_09_BEG' / 'RWY 09 (BEG)' -> '09')."""
    return F.regexp_extract(_col(c), r"RWY[ _]?(\d{2})", 1)


def part_of_zone(c) -> Column:
    """Zone part (BEG / TDZ / MID)."""
    return F.regexp_extract(_col(c), r"(BEG|TDZ|MID)", 1)
