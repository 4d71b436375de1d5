"""Cross-sections worked on whole: one shuffle, and the way for wider groups gives the same rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import features as ft
from tapeloom.operators import xsection as xs
from tapeloom.plans import sections


def section_rows(spark, n=600):
    """Ten dates; one holds a third of all rows, values tie often and some are missing."""
    rng = np.random.default_rng(4)
    day = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 10, n))
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=int(d)), i, int(d), float(np.round(rng.normal(), 1)), None if i % 7 == 0 else float(rng.normal()), 0.1, float(np.round(rng.normal(), 2)))
            for i, d in enumerate(day)]
    return spark.createDataFrame(rows, "date date, symbol long, session_no int, a double, b double, flat double, y double")


def whole_and_wide(monkeypatch, make):
    """Rows by key with every date whole, and with the widest date left to the ranges."""
    out = []
    for most in (1 << 20, 100):
        monkeypatch.setattr(sections, "MOST", most)
        pdf = make().toPandas()
        out.append(pdf.sort_values([c for c in ("fold", "date", "symbol") if c in pdf], ignore_index=True))
    return out


def test_z_scores_take_one_shuffle_and_equal_the_way_by_ranges(spark, monkeypatch):
    df = section_rows(spark)
    whole, wide = whole_and_wide(monkeypatch, lambda: xs.winsorised_z(df, ["date"], "symbol", ["a", "b", "flat"], keep=["session_no"]))
    pd.testing.assert_frame_equal(whole, wide, rtol=0, atol=1e-12)
    assert len(whole) == df.count() and (whole["z_flat"] == 0).all()  # equal values deviate by nothing, whatever rounding their mean has
    monkeypatch.undo()
    plan = xs.winsorised_z(df, ["date"], "symbol", ["a", "b", "flat"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_date_ranks_take_one_shuffle_and_equal_the_way_by_ranges(spark, monkeypatch):
    df = section_rows(spark)
    whole, wide = whole_and_wide(monkeypatch, lambda: ft.rank_normalise(df, ["a", "flat"], ["session_no", "y"]))
    pd.testing.assert_frame_equal(whole, wide, rtol=0, atol=1e-12)
    monkeypatch.undo()
    assert ft.rank_normalise(df, ["a", "flat"], ["y"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("least", [5, 60])
def test_deciles_take_one_shuffle_and_equal_the_way_by_ranges(spark, monkeypatch, least):
    df = section_rows(spark).selectExpr("session_no % 2 AS fold", "date", "symbol", "a AS pred", "y")
    whole, wide = whole_and_wide(monkeypatch, lambda: ft.rank_ic_deciles(df, least))
    assert len(whole) == (df.groupBy("fold", "date").count().filter(f"count >= {least}").count()) > 0
    pd.testing.assert_frame_equal(whole, wide[whole.columns], rtol=0, atol=1e-12)
    monkeypatch.undo()
    assert ft.rank_ic_deciles(df, least)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
