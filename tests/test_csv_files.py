"""CSV files with quotes and line breaks inside them, repeated header rows, damaged files; the final weather columns."""

import datetime as dt
import gzip

from visiflow.plans.cleaning import clean_weather, required_columns_missing
from visiflow.sources.readings import csv_by_header, damaged_files, read_wide_csv, skipped_files


def test_quotes_line_breaks_and_damaged_files(spark, tmp_path):
    base = tmp_path / "a b+c"
    base.mkdir()
    (base / "RVR_1.csv").write_text('Datetime,"RWY 09, BEG","RWY ""10"""\n01/02/2024 10:00,"1,5",700\n"01/02/2024 10:10",800,"9\n"\n')
    (base / "RVR_2.csv").write_text("﻿note: a line before the header\nDatetime,Z\n01/02/2024 10:00,1\nDatetime,Z\n01/02/2024 10:20,2\n\n")
    whole = gzip.compress(b"Datetime,Z\n01/02/2024 11:00,3\n" + b"01/02/2024 11:10,4\n" * 5000)
    (base / "RVR_3.csv.gz").write_bytes(whole)
    (base / "RVR_4.csv.gz").write_bytes(whole[:len(whole) // 2])
    (base / "RVR_5.csv").write_text("a,b\n1,2\n")
    frames = {tuple(sorted(f.columns)): f for f in csv_by_header(spark, str(base), ["Datetime"])}
    assert len(frames) == 2
    quoted = frames[("Datetime", 'RWY "10"', "RWY 09, BEG", "source_file")].orderBy("Datetime").collect()
    assert [(r["Datetime"], r["RWY 09, BEG"], r['RWY "10"'].strip()) for r in quoted] == [("01/02/2024 10:00", "1,5", "700"), ("01/02/2024 10:10", "800", "9")]
    plain = frames[("Datetime", "Z", "source_file")]
    assert plain.count() == 3 + 5001
    got = {r.source_file.rsplit("/", 1)[1]: r.error for r in skipped_files(spark, str(base), ["Datetime"]).collect()}
    assert set(got) == {"RVR_4.csv.gz", "RVR_5.csv"} and got["RVR_5.csv"] == "no header"
    assert damaged_files(spark, str(base)).count() == 1
    long = read_wide_csv(spark, str(base), "Datetime")
    ten = dt.datetime(2024, 2, 1, 10, 0)
    assert {(r.zone, r.rvr) for r in long.filter(long.ts == ten).collect()} >= {('RWY "10"', 700.0), ("Z", 1.0)}


def test_final_weather_columns(spark):
    para = spark.createDataFrame([(dt.datetime(2024, 1, 1), "RUNWAY-28L", 5.0, 1.0, 9.0)], "ts timestamp_ntz, runway string, temperature double, humidity double, spare double")
    wind = spark.createDataFrame([(dt.datetime(2024, 1, 1), "RUNWAY-28", 7.0, 2.0)], "ts timestamp_ntz, runway string, wind_speed double, humidity double")
    out = clean_weather(para, wind)
    assert out.columns == ["ts", "runway", "temperature", "humidity", "wind_speed"] and out.first().humidity == 1.0
    assert required_columns_missing(out) == ["dew_point", "pressure", "qnh", "qfe", "wind_dir"]
