"""Scans that produce the canonical long ``readings(ts, zone, rvr)`` table
and the ``weather`` table.

All readers are declarative Spark reads: file pruning, column pruning and
predicate pushdown are left to the scan.  Nothing is read on the driver.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow import config as C
from visiflow.functions.names import normalize_log_zone
from visiflow.functions.times import parse_date_time, parse_ts
from visiflow.functions.values import to_value

READINGS_SCHEMA = "ts timestamp_ntz, zone string, rvr double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in sensor feed from the ``events`` table.

    Only renames and scales columns into the readings schema:
    ``ts = events.ts``, ``zone = event_type``, ``rvr = value * 10``.
    """
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp_ntz").alias("ts"),
                    F.col("event_type").alias("zone"),
                    (F.col("value") * 10.0).alias("rvr"))


def humidity_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in weather feed: ``humidity`` from the props json, per event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp_ntz").alias("ts"),
                    F.col("event_type").alias("zone"),
                    F.col("user_id"),
                    (F.col("value") * 10.0).alias("rvr"),
                    F.get_json_object("props", "$.k").try_cast("double").alias("humidity"))


# ---------------------------------------------------------------------------
# Raw text logs
# ---------------------------------------------------------------------------

def parse_log_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse raw log lines into long readings.

    Line shape ``dd-MM-yyyy<TAB>HH:mm:ss<TAB><zone> <value>[<TAB>...]``.
    Lines that do not match, or whose date is impossible, are dropped.  Each
    tab separated part is stripped; the zone is everything before its last
    blank and the value the token after it (``-`` or a non-integer -> NULL;
    a part without a blank has an empty zone).
    """
    stripped = F.expr(f"btrim(`{text_col}`, ' \t\r\n')")
    pat = C.LOG_LINE_PATTERN
    df = (lines.select("*", stripped.alias("_line"))
          .filter(F.col("_line").rlike(pat))
          .withColumn("ts", F.try_to_timestamp(
              F.concat_ws(" ", F.regexp_extract("_line", pat, 1), F.regexp_extract("_line", pat, 2)),
              F.lit(C.LOG_TS_FORMAT)).cast("timestamp_ntz"))
          .filter(F.col("ts").isNotNull())
          .withColumn("_part", F.explode(F.split(F.regexp_extract("_line", pat, 3), "\t")))
          .withColumn("_part", F.expr("btrim(_part, ' \t\r\n')"))
          .filter(F.col("_part") != ""))
    has_blank = F.instr("_part", " ") > 0
    zone_raw = F.when(has_blank, F.regexp_extract("_part", r"^(.*) [^ ]*$", 1)).otherwise(F.lit(""))
    token = F.when(has_blank, F.regexp_extract("_part", r" ([^ ]*)$", 1)).otherwise(F.col("_part"))
    value = F.when(token == "-", F.lit(None).cast("int")).otherwise(token.try_cast("int"))
    keep = [c for c in lines.columns if c != text_col]
    return df.select(*keep, "ts", normalize_log_zone(zone_raw).alias("zone"), value.cast("double").alias("rvr"))


def bad_log_line(text_col: str = "value") -> Column:
    """Whether ``parse_log_lines`` drops a line: it is not blank and has the wrong shape or an impossible date."""
    line = F.expr(f"btrim(`{text_col}`, ' \t\r\n')")
    pat = C.LOG_LINE_PATTERN
    at = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(line, pat, 1), F.regexp_extract(line, pat, 2)), F.lit(C.LOG_TS_FORMAT))
    return F.coalesce((line != "") & (~line.rlike(pat) | at.isNull()), F.lit(False))


def scan_logs(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.txt`` below each all-digit year directory of ``root``.

    Adds ``year`` (from the directory) and ``source_file``.
    """
    root = root.rstrip("/")
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
           .text(root)
           .select("value", F.col("_metadata.file_path").alias("source_file")))
    # the year directory is the first path component below root, all digits
    raw = raw.withColumn("source_file", decoded_path("source_file"))
    year = F.regexp_extract("source_file", _re_escape(root) + r"/(\d+)/", 1)
    raw = raw.withColumn("year", year).filter(F.col("year") != "").withColumn("year", F.col("year").cast("int"))
    return parse_log_lines(raw)


def decoded_path(col: str) -> Column:
    """A file path as the user wrote it: scan metadata holds it percent-encoded."""
    return F.url_decode(F.replace(F.col(col), F.lit("+"), F.lit("%2B")))


def _re_escape(s: str) -> str:
    return re.escape(s)


# ---------------------------------------------------------------------------
# S3: wide CSV files (Datetime + one column per zone)
# ---------------------------------------------------------------------------

def wide_to_long(wide: DataFrame, ts_col: str = "Datetime", formats=C.CSV_TS_FORMATS,
                 zone_cols: list[str] | None = None) -> DataFrame:
    """Wide (ts + zone columns) -> long readings; values coerced, null time dropped."""
    zone_cols = zone_cols or [c for c in wide.columns if c not in (ts_col, "source_file") and not c.startswith("_")]
    df = wide.select(parse_ts(F.col(f"`{ts_col}`"), formats).alias("ts"),
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in zone_cols])
    long = df.unpivot(["ts"], zone_cols, "zone", "raw")
    return (long.filter(F.col("ts").isNotNull())
            .select("ts", "zone", to_value("raw").alias("rvr")))


def read_wide_csv(spark: SparkSession, paths: list[str] | str, ts_col: str = "Datetime",
                  formats=C.CSV_TS_FORMATS) -> DataFrame:
    """Read one or more wide CSV files as long readings.

    Files may carry different zone columns, in any order: each is read with its
    own header and they are unioned by name (missing columns are NULL).  All
    columns are read as strings; malformed rows become NULL values; a file
    without a header that names ``ts_col`` is skipped (``skipped_files``).
    """
    frames = csv_by_header(spark, paths, [ts_col])
    if not frames:
        return spark.createDataFrame([], READINGS_SCHEMA)
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return wide_to_long(wide, ts_col, formats)


_CSV = "*.{csv,csv.gz}"
#: One field of a CSV line: quoted (a doubled quote is one) or up to the next comma.
_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _csv_files(spark: SparkSession, paths: list[str] | str, glob: str = _CSV) -> DataFrame:
    """``source_file`` of the CSV files below some paths: a listing, no file is read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
            .select(F.col("_metadata.file_path").alias("source_file")))


def readable_path(uri: str) -> str:
    """A scan's percent-encoded file URI as a path to read, without wildcards."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _csv_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    return (spark.read.text([readable_path(f) for f in files])
            .select(F.btrim("value", F.lit("\ufeff\r")).alias("value"), F.col("_metadata.file_path").alias("source_file"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def _fields(value: Column) -> Column:
    """Fields of one line, quotes taken off."""
    bare = lambda x: F.replace(F.regexp_replace(F.btrim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.regexp_extract_all(value, F.lit(_FIELD), F.lit(1)), lambda x: F.btrim(bare(x)))


def _headers(spark: SparkSession, files: list[str], required: list[str]) -> DataFrame:
    """(source_file, names): the fields of every file's first line that names all ``required`` columns (null: none does)."""
    if not files:
        return spark.createDataFrame([], "source_file string, names array<string>")
    lines = _csv_lines(spark, files).withColumn("names", _fields(F.col("value")))
    named = F.size(F.array_except(F.array(*(F.lit(c) for c in required)), F.col("names"))) == 0
    first = F.min(F.when(named, F.struct("block", "row", "names")))
    return lines.groupBy("source_file").agg(first.alias("first")).select("source_file", F.col("first.names").alias("names"))


def _sound_files(spark: SparkSession, paths: list[str] | str) -> list[str]:
    bad = {r["source_file"] for r in damaged_files(spark, paths).collect()}
    return sorted(r["source_file"] for r in _csv_files(spark, paths).collect() if r["source_file"] not in bad)


def damaged_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(source_file, error): compressed CSV files that do not unpack to their end, each read through by one task."""
    files = _csv_files(spark, paths, "*.csv.gz")

    def check(batches):
        for batch in batches:
            for path in batch.column("source_file").to_pylist():
                try:
                    fs, name = pafs.FileSystem.from_uri(path)
                    with fs.open_input_stream(name, compression="gzip") as f:
                        while f.read(1 << 20):
                            pass
                except OSError as e:
                    yield pa.RecordBatch.from_pylist([{"source_file": path, "error": str(e)[:200]}])

    return files.mapInArrow(check, "source_file string, error string")


def csv_by_header(spark: SparkSession, paths: list[str] | str, required: list[str]) -> list[DataFrame]:
    """One frame of string columns (and ``source_file``) per distinct header of the CSV files.

    The header of a file is its first line that names all ``required`` columns.
    Files of one header are read together by the CSV source, with quotes, doubled
    quotes and line breaks inside quotes; rows before the header (and the header
    itself) are left out by its place, not by its value.  The lists of files, which
    the scan needs anyway, and the distinct headers are all that reaches the
    driver.  Damaged files are left out whole (``skipped_files`` names them).
    """
    heads = _headers(spark, _sound_files(spark, paths), required).filter(F.col("names").isNotNull())
    out = []
    for r in heads.groupBy("names").agg(F.sort_array(F.collect_list("source_file")).alias("files")).orderBy("names").collect():
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in r["names"])
        raw = (spark.read.schema(schema).option("header", "false").option("multiLine", "true").option("quote", '"').option("escape", '"')
               .option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").option("mode", "PERMISSIVE")
               .csv([readable_path(f) for f in r["files"]]))
        rows = raw.select(F.col("_metadata.file_path").alias("source_file"), *[F.col(f"`{n.replace('`', '``')}`") for n in r["names"]])
        # the first row of a file that is its header; a whole file is one task, so that rows keep their order
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        is_head = F.forall(F.array(*[F.coalesce(F.btrim(F.regexp_replace(f"`{n.replace('`', '``')}`", "^\ufeff", "")) == F.lit(n), F.lit(n == "")) for n in r["names"]]), lambda x: x)
        at = rows.filter(is_head).groupBy(F.col("source_file").alias("_file")).agg(F.min("_row").alias("_head"))
        out.append(rows.join(at, F.col("source_file") == F.col("_file")).filter(F.col("_row") > F.col("_head")).drop("_file", "_head", "_row"))
    return out


def skipped_files(spark: SparkSession, paths: list[str] | str, required: list[str]) -> DataFrame:
    """(source_file, error) of every CSV file that ``csv_by_header`` leaves out: damaged, or without such a header."""
    bare = _headers(spark, _sound_files(spark, paths), required).filter(F.col("names").isNull())
    return damaged_files(spark, paths).unionByName(bare.select("source_file", F.lit("no header").alias("error")))


# ---------------------------------------------------------------------------
# Weather feeds, year selection, newest file, time column
# ---------------------------------------------------------------------------

def weather_from_frame(df: DataFrame, runway_col: str = "runway",
                       fmt: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """Raw weather columns -> ``weather(ts, runway, <canonical measures>)``."""
    cols = [F.col(f"`{src}`").try_cast("double").alias(dst)
            for src, dst in zip(C.WEATHER_COLUMNS[2:], C.WEATHER_CANONICAL) if src in df.columns]
    ts = parse_date_time(F.col("Date"), F.col("Time"), fmt)
    source = ["source_file"] if "source_file" in df.columns else []
    return df.select(ts.alias("ts"), F.col(runway_col).alias("runway"), *cols, *source).filter(F.col("ts").isNotNull())


def read_weather(spark: SparkSession, path: str, fmt: str = "csv",
                 ts_format: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """Weather files named ``<runway>_<year>.<ext>`` (or folders of that name).

    The runway comes from the file or folder name; all files below ``path``
    are read, CSV files each by its own header (unioned by name; a file whose
    header lacks Date or Time is skipped).
    """
    runway = F.regexp_extract(decoded_path("source_file"), r"/([^/_]+)_\d{4}[^/]*(/[^/]*)?$", 1)
    if fmt == "csv":
        frames = csv_by_header(spark, path, ["Date", "Time"])
    else:
        frames = [spark.read.option("recursiveFileLookup", "true").format(fmt).load(path)
                  .withColumn("source_file", F.col("_metadata.file_path"))]
    parts = [weather_from_frame(f.withColumn("runway", runway), "runway", ts_format) for f in frames]
    if not parts:
        return spark.createDataFrame([], "ts timestamp_ntz, runway string, source_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def select_year(df: DataFrame, year: int, year_col: str = "year") -> DataFrame:
    """Partition filter on a year-partitioned table (pruned at the scan)."""
    return df.filter(F.col(year_col) == F.lit(year))


def newest_file_rows(df: DataFrame) -> DataFrame:
    """Rows of the most recently modified input file(s) of a file scan."""
    d = df.withColumn("_mtime", F.col("_metadata.file_modification_time"))
    newest = d.agg(F.max("_mtime").alias("_mtime"))     # one row: broadcast-sized by construction
    return d.join(F.broadcast(newest), "_mtime", "left_semi").drop("_mtime")


def newest_file(spark: SparkSession, path: str, glob: str = "*") -> str | None:
    """Path of the most recently modified file below ``path`` (ties: last name); lists files, reads none."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
             .select("path", "modificationTime"))
    row = files.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).first()
    return row["path"] if row else None


def time_column(df: DataFrame) -> str | None:
    """First column whose name contains 'date' or 'time' (schema only, no job)."""
    for c in df.columns:
        low = c.lower()
        if "date" in low or "time" in low:
            return c
    return None
