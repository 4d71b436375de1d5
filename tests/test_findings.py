"""Queries against their SQL on tables that the given ones do not show."""

import math
import os

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tapeloom.llm.common import keep
from tapeloom.operators import audits as ad
from tapeloom.session import ensure_checkpoint_dir
from tapeloom.sources import tables as src
from tapeloom.suite import audits as suite_audits

SMALL = "/root/testdata/sf0.001"


def folder(spark, tmp_path, **tables):
    """The small tables with some of them replaced."""
    for name in os.listdir(SMALL):
        if name.split(".")[0] not in tables:
            os.symlink(f"{SMALL}/{name}", tmp_path / name)
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def both(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    got, cur = queries()[name](spark, sf), con.execute(oracle_sql()[name])
    assert got.columns == [d[0] for d in cur.description]
    return sorted(map(tuple, got.collect()), key=str), sorted(cur.fetchall(), key=str)


def test_back_adjust_by_a_product_too_small_for_a_double(spark, tmp_path):
    day = "CAST('{}' AS TIMESTAMP)"
    line = f"SELECT * REPLACE (1 AS l_suppkey, 1.0 AS l_quantity, exp({{}}) AS l_extendedprice, {day} AS l_shipdate) FROM (SELECT * FROM '{SMALL}/lineitem.parquet' LIMIT 1)"
    lines = f"{line.format(10, '1997-01-07')} UNION ALL {line.format(2, '1997-01-14')}"
    orders = f"SELECT * REPLACE (1 AS o_custkey, '2-HIGH' AS o_orderpriority, {day.format('1997-01-14')} AS o_orderdate) FROM '{SMALL}/orders.parquet' LIMIT 600"
    got, want = both(spark, folder(spark, tmp_path, lineitem=lines, orders=orders), "back_adjust")
    assert got == want
    assert sorted(r[2] for r in got) == [-math.inf, 0.0]


def test_record_fingerprint_sees_a_change_where_every_session_wins(spark, tmp_path):
    orders = f"SELECT * REPLACE (500000.0 AS o_totalprice) FROM '{SMALL}/orders.parquet'"
    got, want = both(spark, folder(spark, tmp_path, orders=orders), "record_fingerprint")
    assert got == want


def test_truncation_mismatches_count_surplus_rows_of_both_sides(spark):
    schema = "date int, x double"
    full = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, None), (2, 2.0), (9, 9.0)], schema)
    part = spark.createDataFrame([(1, 1.0), (1, None), (1, None), (2, 2.0), (2, float("nan"))], schema)
    early = full["date"] <= 2
    assert ad.truncation_mismatches(full, part, early).first()[0] == 3
    assert ad.truncation_mismatches(full, full.filter(early), early).first()[0] == 0
    assert ad.truncation_mismatches(full.limit(0), full.limit(0), early).first()[0] == 0


def test_truncation_invariance_builds_each_panel_once(spark, monkeypatch):
    built, bars = [], src.weekly_bars
    monkeypatch.setattr(src, "weekly_bars", lambda spark, sf: built.append(sf) or bars(spark, sf))
    monkeypatch.setattr(suite_audits, "CAUSAL", ("sma", "rank_top_n", "breadth"))
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    got = queries()["truncation_invariance"](spark, SMALL)
    assert sorted(map(tuple, got.collect())) == [("breadth", 0), ("rank_top_n", 0), ("sma", 0)]
    assert len(built) == len(set(built)) == 2
    assert not [f for f in set(os.listdir(shared)) - before if f.startswith(("cut-", "stored-"))]


def test_kept_frames_are_packed(spark):
    """Kept texts lie beside the shuffles of later stages; the pipeline's disk is counted with them."""
    files = keep(spark.range(3).withColumn("text", F.lit("some text"))).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_percentile_of_lays_the_eligible_rows_out_once(spark, monkeypatch):
    from tapeloom.operators import xsection as xs
    from tapeloom.suite import load_all
    taken, real = [], xs.settle
    monkeypatch.setattr(xs, "eligibility", lambda *a, real=xs.eligibility: taken.append(1) or real(*a))
    kept = []
    from tapeloom.operators import statistics as st
    for module in (xs, st):
        monkeypatch.setattr(module, "settle", lambda df, *cols: kept.append(getattr(df, "_settled", False) or "eligible" not in df.columns) or real(df, *cols))
    assert load_all()[0]["percentile_of"](spark, "/root/testdata/sf0.001").count() == 1
    assert taken == [1] and all(kept)


def test_control_verdict_builds_bars_once(spark, monkeypatch):
    from tapeloom.sources import tables as src
    from tapeloom.suite import load_all
    built = []
    monkeypatch.setattr(src, "weekly_bars", lambda *a, real=src.weekly_bars: built.append(1) or real(*a))
    got = load_all()[0]["control_verdict"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1 and built == [1]
