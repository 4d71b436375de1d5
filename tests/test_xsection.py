"""Ranking, selection and statistics against known answers, planted edges and closed forms."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.operators import features as ft
from tapeloom.operators import statistics as st
from tapeloom.operators import xsection as xs

D = dt.date


def series(frame, closes, symbol="A"):
    rows = [(symbol, i + 1, D(2020, 1, 1) + dt.timedelta(days=i), float(c), float(c), float(c), float(c), 1.0, 1e9) for i, c in enumerate(closes) if c is not None]
    return frame(rows, "symbol string, session_no int, date date, open double, high double, low double, close double, volume double, turnover double")


def test_momentum_skips_the_last_month_and_needs_both_ends(frame):
    closes = [100.0] * 300
    closes[300 - 22] = 150.0
    got = series(frame, closes).withColumn("m", ind.momentum()).orderBy("session_no").collect()
    assert got[-1]["m"] == pytest.approx(0.5) and all(r["m"] is None for r in got[:252])
    gap = [None if i == 20 else 100.0 for i in range(300)]
    hole = series(frame, gap).withColumn("m", ind.momentum()).filter("session_no = 273").first()
    assert hole["m"] is None


def test_ties_go_to_the_smaller_symbol(frame):
    d = D(2020, 1, 1)
    df = frame([(d, s, v, e) for s, v, e in (("A", .5, True), ("B", .9, True), ("C", .7, True), ("D", .99, False))], "date date, symbol string, score double, eligible boolean")
    assert [r["symbol"] for r in xs.rank_top_n(df, 2).orderBy("rank").collect()] == ["B", "C"]
    tie = frame([(d, s, 1.0, True) for s in "CBA"], "date date, symbol string, score double, eligible boolean")
    assert [r["symbol"] for r in xs.rank_top_n(tie, 2).orderBy("rank").collect()] == ["A", "B"]


def test_winsorised_scores(frame):
    d = D(2020, 1, 1)
    vals = [1.0, 1.1, 0.9, 1.05, 0.95, 1000.0]
    df = frame([(d, str(i), v, 5.0) for i, v in enumerate(vals)] + [(d, "n", None, 5.0)], "date date, symbol string, a double, b double")
    got = {r["symbol"]: r for r in xs.winsorised_z(df, ["date"], "symbol", ["a", "b"]).collect()}
    assert got["5"]["z_a"] == 3.0 and got["n"]["z_a"] == 0.0 and all(r["z_b"] == 0.0 for r in got.values())
    med = np.median(vals)
    mad = np.median(np.abs(np.array(vals) - med))
    assert got["0"]["z_a"] == pytest.approx((1.0 - med) / (1.4826 * mad))


def test_gates_fail_in_order_and_missing_values_fail(frame):
    d = D(2020, 1, 1)
    schema = "date date, symbol string, bars long, close double, median_turnover double, median_volume double, zero_volume_frac double, atr_pct double"
    rows = [("GOOD", 800, 500.0, 1e8, 1e6, 0.0, 0.02), ("CHEAP", 800, 10.0, 1e8, 1e6, 0.0, 0.02), ("THIN", 800, 500.0, 1e5, 1e6, 0.0, 0.02),
            ("SHORT", 80, 500.0, 1e8, 1e6, 0.0, 0.02), ("NOATR", 800, 500.0, 1e8, 1e6, 0.0, None), ("BIG", 800, 500.0, 1e8, 10.0, 0.0, 0.02)]
    got = {r["symbol"]: r["gate"] for r in xs.with_first_failed_gate(frame([(d, *r) for r in rows], schema)).collect()}
    assert got == {"GOOD": "survived", "CHEAP": "price", "THIN": "turnover", "SHORT": "history", "NOATR": "atr", "BIG": "participation"}


def bartlett(x, lags):
    x = np.asarray(x)
    e, n = x - x.mean(), len(x)
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    se = np.sqrt(max(var, 0) / n)
    return x.mean(), se, x.mean() / se


def test_newey_west_closed_form_and_short_series(spark):
    rng = np.random.default_rng(4)
    x = np.convolve(rng.normal(size=1500), np.ones(20) / 20, "valid") + 0.01
    df = spark.createDataFrame(pd.DataFrame({"session_no": range(len(x)), "v": x}))
    got = st.newey_west(df, "v", 21).first()
    assert (got["mean"], got["se"], got["t"]) == pytest.approx(bartlett(x, 21))
    assert st.newey_west(df.limit(20), "v", 21).first()["t"] is None


def test_alpha_beta_closed_form(spark):
    rng = np.random.default_rng(5)
    rb = rng.normal(0, 0.01, 600)
    rs = rb + 0.0008 + rng.normal(0, 0.001, 600)
    df = spark.createDataFrame(pd.DataFrame({"rs": rs, "rb": rb}))
    got = st.alpha_beta(df).first()
    beta, alpha = np.polyfit(rb, rs, 1)
    s = (rs - alpha - beta * rb).std(ddof=0) * np.sqrt(600 / 598)
    assert got["beta"] == pytest.approx(beta) and got["t_alpha"] == pytest.approx(alpha / (s / np.sqrt(600)), rel=1e-3) and got["t_alpha"] > 2
    assert st.alpha_beta(df.limit(10)).first()["beta"] is None


def control(spark, edge, seed):
    p = ft.synthetic_panel(spark, 60, 330, seed=seed, edge=edge)
    return xs.eligibility(p, xs.ScreenParams(look=126, skip=10, turnover_window=20))


def test_planted_edge_is_found_and_noise_is_quiet(spark):
    p = st.SpreadParams(n_side=10, step=21, look=126, skip=10)
    planted = st.newey_west(st.decile_spread(control(spark, 0.004, 3), p), "spread", 21).first()
    noise = st.newey_west(st.decile_spread(control(spark, 0.0, 3), p), "spread", 21).first()
    assert planted["t"] > 3 and abs(noise["t"]) < 3
    fm = st.fama_macbeth(st.fama_macbeth_slopes(control(spark, 0.004, 3), p, 30)).first()
    assert fm["mean"] > 0 and fm["periods"] >= 8


def test_synthetic_panel_does_not_depend_on_partitioning(spark):
    a = ft.synthetic_panel(spark, 10, 20, seed=1).agg(F.sum("close")).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    b = ft.synthetic_panel(spark, 10, 20, seed=1).agg(F.sum("close")).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == pytest.approx(b, rel=1e-12)


def test_too_short_panel_raises(spark):
    df = spark.range(50).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    with pytest.raises(ft.InsufficientHistory):
        ft.walk_forward_folds(df)


def test_folds_are_purged_and_ordered():
    for f in ft.fold_ranges(500):
        assert f["train_to"] <= f["test_from"] - 21 and f["test_from"] < f["test_to"] <= 500


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("date"), F.col("id").alias("symbol"), F.rand(1).alias("score"), F.lit(True).alias("eligible"))
    assert "WindowGroupLimit" in xs.rank_top_n(df, 5)._jdf.queryExecution().executedPlan().toString()


def test_efficiency_and_slope(frame):
    line = series(frame, [100.0 + i for i in range(100)])
    assert ind.with_efficiency_ratio(line, 63).orderBy(F.col("session_no").desc()).first()["efficiency"] == pytest.approx(1.0)
    vee = series(frame, list(np.r_[np.linspace(200, 100, 32), np.linspace(103.2258, 200, 32)]))
    assert ind.with_efficiency_ratio(vee, 63).orderBy(F.col("session_no").desc()).first()["efficiency"] < 0.01
    flat = series(frame, [50.0] * 95).withColumn("s", ind.rolling_slope_r2(90)).orderBy(F.col("session_no").desc()).first()
    assert flat["s"] == pytest.approx(0.0)


def test_wilder_atr_matches_pandas(frame, spark):
    rng = np.random.default_rng(7)
    c = 500 + np.cumsum(rng.normal(size=60))
    rows = [("A", i + 1, float(x), float(x + 2), float(x - 2)) for i, x in enumerate(c)]
    got = ind.atr_wilder(frame(rows, "symbol string, session_no int, close double, high double, low double")).orderBy("session_no").toPandas()
    prev = pd.Series(c).shift(1)
    tr = pd.concat([pd.Series(np.full(60, 4.0)), (c + 2 - prev).abs(), (c - 2 - prev).abs()], axis=1).max(axis=1)
    want = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert np.allclose(got["atr"].astype(float), want, equal_nan=True)
