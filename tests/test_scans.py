"""Series cut into ranges: exponential means and carried values equal plain pandas, and no task gets a whole hot series."""

import contextlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.indicators import FactorParams, compute_factors
from tapeloom.plans import scans
from tapeloom.plans.ordered import PART, last_known, lay_out

SPECS = {"fast": ("x", 2 / 6, 1), "slow": ("x", 2 / 21, 20), "other": ("y", 1 / 14, 3)}


def series(seed=5, n=6000):
    """A third of all rows are of one symbol; values are missing singly, in long stretches and for whole series."""
    rng = np.random.default_rng(seed)
    symbol = np.where(rng.random(n) < 1 / 3, 7, rng.integers(0, 60, n))
    pdf = pd.DataFrame({"symbol": symbol, "at": rng.permutation(n), "x": rng.normal(100, 9, n), "y": rng.normal(0, 1, n), "a.b": 1})
    pdf.loc[rng.random(n) < 0.2, "x"] = np.nan
    pdf.loc[pdf["at"].between(1000, 2500), "y"] = np.nan
    pdf.loc[pdf["symbol"] == 3, "x"] = np.nan
    return pdf


@contextlib.contextmanager
def many_ranges(spark, **more):
    """Nine ranges that are not joined for being small."""
    wanted = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false", **more}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plain(pdf):
    pdf = pdf.sort_values(["symbol", "at"])
    for name, (col, alpha, least) in SPECS.items():
        pdf[name] = pdf.groupby("symbol")[col].transform(lambda v, alpha=alpha, least=least: v.ewm(alpha=alpha, adjust=False, min_periods=least).mean())
    return pdf.reset_index(drop=True)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_exponential_means_over_ranges_equal_pandas(spark, batch):
    pdf = series()
    df = spark.createDataFrame(pdf.drop(columns="a.b")).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})
    with many_ranges(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": batch}):
        got = scans.exponential_means(df, ["symbol"], "at", SPECS).toPandas().sort_values(["symbol", "at"], ignore_index=True)
        parts = lay_out(df, ["symbol"], [F.col("at")]).groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("symbol") == 7, F.lit(7))).alias("hot")).toPandas()
    want = plain(pdf)
    for c in SPECS:
        assert np.allclose(got[c].astype(float), want[c], rtol=0, atol=1e-9, equal_nan=True), c
    assert parts["hot"].sum() >= 3 and parts["n"].max() < len(pdf) / 4


def test_long_decays_do_not_overflow():
    x = np.full(100_000, np.nan)
    x[[0, 5, 99_999]] = 1.0, 2.0, 3.0
    a, b, count, gap = scans.maps(x, np.array([0]), scans.Start.nothing(1), 0.3)
    got = scans.composed(a, b, len(x))[1]
    want = pd.Series(x).ewm(alpha=0.3, adjust=False).mean()
    assert np.allclose(got, want) and count[-1] == 3 and gap[-2] == 99_993


@pytest.mark.parametrize("strictly", [False, True])
def test_last_known_over_ranges_equals_pandas(spark, strictly):
    pdf = series(9)
    df = spark.createDataFrame(pdf[["symbol", "at", "x", "y"]]).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})
    with many_ranges(spark):
        got = last_known(df, ["symbol"], ["at"], {"lx": "x", "ly": "y"}, strictly).toPandas().sort_values(["symbol", "at"], ignore_index=True)
    pdf = pdf.sort_values(["symbol", "at"], ignore_index=True)
    for name, c in (("lx", "x"), ("ly", "y")):
        want = pdf.groupby("symbol")[c].ffill()
        want = want.groupby(pdf["symbol"]).shift() if strictly else want
        assert np.allclose(got[name].astype(float), want, equal_nan=True)


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, None)], "symbol string, at long, x double")
    specs = {"m": ("x", 0.5, 1)}
    assert {r["symbol"]: r["m"] for r in scans.exponential_means(df, ["symbol"], "at", specs).collect()} == {"a": 2.0, "b": None}
    assert scans.exponential_means(df.limit(0), ["symbol"], "at", specs).count() == 0 and last_known(df.limit(0), ["symbol"], ["at"], {"k": "x"}).count() == 0


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_exponential_means_of_bars_equal_pandas_without_a_layout(spark, batch, monkeypatch):
    pdf = series()
    df = spark.createDataFrame(pdf.drop(columns="a.b")).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})
    monkeypatch.setattr(scans, "lay_out", None)
    with many_ranges(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": batch}):
        got = scans.exponential_means_of_bars(df.repartition("symbol"), ["symbol"], "at", SPECS).toPandas().sort_values(["symbol", "at"], ignore_index=True)
    want = plain(pdf)
    for c in SPECS:
        assert np.allclose(got[c].astype(float), want[c], rtol=0, atol=1e-9, equal_nan=True), c


def test_factors_need_no_range_layout(spark, monkeypatch):
    """Windows by symbol are taken anyway, so the recursion streams through their partitions."""
    monkeypatch.setattr(scans, "lay_out", None)
    bars = spark.range(400).selectExpr("id % 2 AS symbol", "CAST(id DIV 2 AS INT) AS session_no", "date_add(DATE'2026-01-01', CAST(id DIV 2 AS INT)) AS date", "100.0D + id % 7 AS close",
                                       "100.0D AS open", "110.0D AS high", "90.0D AS low", "5.0D AS volume", "500.0D AS turnover")
    got = compute_factors(bars, FactorParams(short=2, medium=4, long=6, year=8, skip=2, slope=5, efficiency=5, fast=3, slow=6)).toPandas()
    assert len(got) == 2 * (200 - 14) and np.allclose(got["atr_pct"] * got["close"], 20.0)
