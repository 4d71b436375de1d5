"""One key with a third of all rows: results stay whole and no task receives a whole hot group of raw rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import calendars as cal
from tapeloom.operators import features as ft
from tapeloom.operators import identity as ident
from tapeloom.operators import records as rc
from tapeloom.operators import statistics as st
from tapeloom.sources import tables as src


def hot_ticks(spark, n=9000):
    rng = np.random.default_rng(2)
    sym = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 50, n))
    pdf = pd.DataFrame({"symbol": sym, "bucket": rng.integers(0, 5, n), "seq": np.arange(n), "px": rng.normal(100, 5, n)})
    return pdf, spark.createDataFrame(pdf)


def test_bars_of_a_hot_symbol_are_reduced_before_the_shuffle(spark):
    pdf, df = hot_ticks(spark)
    bars = src.bars_from_ticks(df, ["symbol", "bucket"], ["seq"], "px")
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning(symbol")  # printed child last: partial runs below the exchange
    got = bars.toPandas().set_index(["symbol", "bucket"]).sort_index()
    g = pdf.sort_values("seq").groupby(["symbol", "bucket"])["px"]
    for name, want in (("open", g.first()), ("close", g.last()), ("high", g.max()), ("low", g.min())):
        assert np.allclose(got[name], want)


def test_keep_last_of_a_hot_key(spark):
    pdf, df = hot_ticks(spark)
    got = cal.dedupe_keep_last(df, ["symbol"], ["seq"]).toPandas().set_index("symbol").sort_index()
    assert (got["seq"] == pdf.groupby("symbol")["seq"].max()).all()


def test_hot_session_limit_audit_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    n = 1500
    day = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 30, n))
    pdf = pd.DataFrame({"trade_date": [dt.date(2026, 1, 1) + dt.timedelta(days=int(d)) for d in day], "trade_id": np.arange(n),
                        "open_min": rng.integers(555, 900, n), "net_pnl": np.round(rng.normal(0, 60, n), 2)})
    pdf["close_min"] = pdf["open_min"] + rng.integers(1, 60, n)
    p = rc.LimitParams(400.0, 500.0, 4, 10)
    got = {r["trade_date"]: r for r in rc.session_limit_audit(spark.createDataFrame(pdf), p).collect()}
    for d, g in pdf.sort_values(["close_min", "trade_id"]).groupby("trade_date"):
        run = streak = longest = 0
        halt = None
        for r in g.itertuples():
            run += r.net_pnl
            streak = streak + 1 if r.net_pnl < 0 else 0
            longest = max(longest, streak)
            kind = "loss_limit" if run <= -400 else "profit_lock" if run >= 500 else "consecutive_losses" if streak >= 4 else None
            halt = halt or (kind and (r.close_min, kind))
        assert got[d]["longest_losing_streak"] == longest
        assert (got[d]["halt_min"], got[d]["halt_kind"]) == (halt or (None, None))
        assert got[d]["opened_after_halt"] == (0 if halt is None else int((g["open_min"] > halt[0]).sum()))


def test_hot_date_rank_ic_equals_pandas(spark):
    rng = np.random.default_rng(4)
    n = 900
    date = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 10, n))
    pdf = pd.DataFrame({"fold": 1, "date": [dt.date(2026, 1, 1) + dt.timedelta(days=int(d)) for d in date], "symbol": [f"S{i:04d}" for i in range(n)],
                        "pred": np.where(rng.random(n) < 1 / 3, 0.0, rng.normal(size=n)), "y": rng.normal(size=n)})
    got = {r["date"]: r for r in ft.rank_ic_deciles(spark.createDataFrame(pdf)).collect()}
    for d, g in pdf.groupby("date"):
        if len(g) < 20:
            assert d not in got
            continue
        assert got[d]["ic"] == pytest.approx(g["pred"].rank().corr(g["y"].rank()))
        k = max(1, len(g) // 10)
        order = g.sort_values(["pred", "symbol"])
        assert got[d]["bottom"] == pytest.approx(order["y"].head(k).mean()) and got[d]["top"] == pytest.approx(order["y"].tail(k).mean())


def test_random_null_is_reproducible_and_whole(spark):
    p = ft.synthetic_panel(spark, 30, 80, seed=2)
    from tapeloom.operators import xsection as xs
    scored = xs.eligibility(p, xs.ScreenParams(look=20, skip=2, turnover_window=10))
    a = st.random_null(scored, 5, 10, 20).orderBy("trial").collect()
    b = st.random_null(scored.repartition(7), 5, 10, 20).orderBy("trial").collect()
    assert len(a) == 20 and len({round(r["total_pct"], 6) for r in a}) > 10
    assert [r["total_pct"] for r in a] == pytest.approx([r["total_pct"] for r in b])


def test_hub_symbol_joins_many_keys(spark):
    """A third of all identity pairs hang on one ticker."""
    rows = [(dt.date(2020, 1, 1), f"I{i:04d}", "HUB" if i % 3 == 0 else f"S{i}") for i in range(300)]
    ents = ident.resolve_entities(spark.createDataFrame(rows, "date date, isin string, symbol string"))
    s = ents.stats().first()
    assert (s["isins"], s["entities"], s["merged"]) == (300, 201, 1)
    assert ents.by_isin.filter((F.col("entity") == "I0000")).count() == 100
