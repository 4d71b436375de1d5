"""Files on disk: archive day-files, stores, panels, upserts."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.sources import archive, stores

D = dt.date


def test_day_files_found_but_unreadable_are_not_holidays(spark, tmp_path):
    (tmp_path / "20200101.csv").write_text("SYMBOL,CLOSE\nA,10\nB,11\n")
    (tmp_path / "20200102.csv").write_text("SYMBOL,CLOSE\nA,ten\nB,x\n")
    schema = T.StructType([T.StructField("SYMBOL", T.StringType()), T.StructField("CLOSE", T.DoubleType())])
    files = archive.scan_day_files(spark, str(tmp_path), schema)
    cal = archive.weekday_calendar(spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 5))], "first date, last date"))
    got = {r["date"]: r["status"] for r in archive.archive_day_status(cal, files).collect()}
    assert got == {D(2020, 1, 1): "present", D(2020, 1, 2): "unreadable", D(2020, 1, 3): "absent"}


def test_archive_round_trip_prunes_years(spark, tmp_path):
    rows = [(D(y, 3, 1), f"INE{y:09d}", 1.0) for y in range(2000, 2010)]
    archive.write_archive(spark.createDataFrame(rows, "date date, isin string, close double"), str(tmp_path / "a"))
    got = archive.archive_range_scan(spark.read.parquet(str(tmp_path / "a")), "2003-01-01", "2005-12-31")
    assert sorted(r["date"].year for r in got.collect()) == [2003, 2004, 2005]
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().toString()


def test_json_store(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"companies": {"AAA": {"sector": "x", "cap": 1.5}, "BBB": {"sector": "y", "cap": None}}}, indent=1))
    rec = T.StructType([T.StructField("sector", T.StringType()), T.StructField("cap", T.DoubleType())])
    got = {r["symbol"]: (r["sector"], r["cap"]) for r in stores.scan_json_store(spark, str(tmp_path / "s.json"), rec).collect()}
    assert got == {"AAA": ("x", 1.5), "BBB": ("y", None)}


def test_upsert_replaces_and_skips_blank_keys(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, v int")
    new = spark.createDataFrame([("B", 3), (" ", 9), ("C", 4)], "symbol string, v int")
    assert sorted(map(tuple, stores.upsert_by_key(old, new).collect())) == [("A", 1), ("B", 3), ("C", 4)]


def test_reports_are_written_both_ways(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    stores.write_reports({"r": df}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).first()["k"] == "a"
    assert spark.read.json(str(tmp_path / "r.json")).first()["n"] == 1


def test_scan_bars_end_is_inclusive_and_short_series_drop(spark):
    rows = [("A", dt.datetime(2020, 1, d)) for d in range(1, 6)] + [("B", dt.datetime(2020, 1, 2))]
    df = spark.createDataFrame(rows, "symbol string, date timestamp")
    got = stores.scan_bars(df, "2020-01-02", "2020-01-03", 2)
    assert {r["symbol"] for r in got.collect()} == {"A"} and got.agg(F.max("date")).first()[0] == dt.datetime(2020, 1, 4)
