"""Shared SQL fragments for oracle queries (DuckDB dialect, ANSI where possible).

The stand-in feed is ``events``: ts -> ts, event_type -> zone, value*10 -> rvr.
"""

READINGS = """
readings AS (
  SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS zone, value * 10.0 AS rvr FROM events
)"""

BINS = READINGS + """,
bins AS (
  SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, zone, avg(rvr) AS rvr,
         count(rvr) AS n_readings,
         sum(CASE WHEN rvr = 3333.0 THEN 1 ELSE 0 END) * 1.0 / count(*) AS sentinel_share
  FROM readings GROUP BY 1, 2
)"""

CELLS = BINS + """,
axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM bins)),
cells AS (SELECT b.*, a.pos FROM bins b JOIN axis a USING (ts))"""

VALID = READINGS + """,
valid AS (
  SELECT ts, zone, rvr, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS vidx
  FROM readings WHERE rvr > 0 AND rvr < 3333.0
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"
