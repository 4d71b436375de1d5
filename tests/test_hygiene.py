"""Actions, identity and price hygiene on small known cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import actions as act
from tapeloom.operators import hygiene as hyg
from tapeloom.operators import identity as ident
from tapeloom.sources.tables import with_sessions

D = dt.date
PRICEABLE = [("Bonus 1:1", 0.5), ("Bonus 1 : 2", 2 / 3), ("BONUS-3:1", 0.25), ("Fv Split Rs.10/- To Re.1/-", 0.1), ("Split-Rs.10tors.2", 0.2),
             ("Spl-Rs10 To Rs2", 0.2), ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 1/- Per Share", 0.1), ("Spl-Rs10 To Rs5/Bonus-1:1", 0.25),
             ("Split 10 to 1", 0.1)]
OTHER = ["Dividend - Re 0.40 Per Sh", "", None, "Annual General Meeting", "Interest Payment", "Consolidation Rs 1 To Rs 10"]


def test_action_texts(frame):
    rows = [(t, f) for t, f in PRICEABLE] + [(t, None) for t in OTHER]
    got = act.parse_action_factor(frame(rows, "subject string, want double")).collect()
    for r in got:
        assert (r["factor"] is None) == (r["want"] is None), r
        assert r["want"] is None or r["factor"] == pytest.approx(r["want"]), r


def test_three_way_confirmation(frame):
    prices = frame([("A", D(2020, 1, 1), 100.0), ("A", D(2020, 1, 2), 99.0), ("B", D(2020, 1, 1), 100.0), ("B", D(2020, 1, 2), 50.5)], "symbol string, date date, close double")
    acts = frame([("A", D(2020, 1, 2), 0.5), ("B", D(2020, 1, 2), 0.5), ("B", D(2021, 6, 1), 0.5)], "symbol string, ex_date date, factor double")
    checked = act.confirm_actions(acts, prices)
    got = {(r["symbol"], r["ex_date"]): r["status"] for r in checked.collect()}
    assert got == {("A", D(2020, 1, 2)): "rejected", ("B", D(2020, 1, 2)): "confirmed", ("B", D(2021, 6, 1)): "out_of_range"}
    assert act.confirmation_rate(checked).first()["rate"] == 0.5
    adj = act.back_adjust(prices.withColumn("open", F.col("close")), checked.filter("status = 'confirmed'"))
    assert {(r["symbol"], r["date"].day): r["close"] for r in adj.collect()}[("B", 1)] == 50.0


def identity(frame, rows):
    return {r["isin"]: r["entity"] for r in ident.resolve_entities(frame(rows, "date date, isin string, symbol string")).by_isin.collect()}


def test_key_change_and_rename_are_one_company(frame):
    got = identity(frame, [(D(2010, 1, 1), "I1", "A"), (D(2010, 6, 1), "I2", "A"), (D(2010, 7, 1), "I2", "B"), (D(2010, 8, 1), "I3", "B"), (D(2010, 1, 1), "I9", "Z")])
    assert got["I1"] == got["I2"] == got["I3"] != got["I9"]


def test_reused_ticker_is_two_companies(frame):
    got = identity(frame, [(D(2006, 1, 1), "I1", "A"), (D(2020, 1, 1), "I2", "A")])
    assert got["I1"] != got["I2"]


def bars(frame, closes, symbol="A"):
    return frame([(symbol, D(2022, 1, 1) + dt.timedelta(days=i), float(c), float(c), float(c), float(c), 1.0) for i, c in enumerate(closes)],
                 "symbol string, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("closes,bad", [([900, 905, 912, 468, 900, 898], [3]), ([620, 621, 304, 305, 306], []), ([100, 99, 79, 76, 75], []), ([100, 50], [])])
def test_bad_prints(frame, closes, bad):
    rows = hyg.bad_prints(bars(frame, closes)).orderBy("date").collect()
    assert [i for i, r in enumerate(rows) if r["bad"]] == bad


def test_series_with_too_many_bad_prints_is_dropped(frame):
    assert hyg.mask_bad_prints(bars(frame, [100, 50] * 10), most=3).count() == 0


def test_jump_blanks_earlier_history(frame):
    rows = hyg.quarantine_jumps(with_sessions(bars(frame, [100, 101, 9.9, 10, 10.1]))).orderBy("date").collect()
    assert [r["close"] for r in rows] == [None, None, 9.9, 10.0, 10.1]
    assert all(r["volume"] == 1.0 for r in rows)


def test_split_detection_needs_a_lasting_move(frame):
    split = bars(frame, [620, 621, 310, 312, 311])
    assert [r["nearest"] for r in hyg.split_detect(split).collect()] == ["1/2"]
    assert hyg.split_detect(bars(frame, [900, 905, 452, 900, 898])).count() == 0


def test_build_panel_end_to_end(frame):
    """A split filed under the retired key is adjusted; a name with an unexplained jump is quarantined."""
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(5)]
    rows = [(d, "INE000000001" if i < 2 else "INE000000002", "A", "EQ", p, p, 10.0, p * 10) for i, (d, p) in enumerate(zip(days, [100.0, 102.0, 51.0, 52.0, 53.0]))]
    rows += [(d, "INE000000009", "Z", "EQ", p, p, 10.0, p * 10) for d, p in zip(days, [100.0, 101.0, 9.9, 10.0, 10.1])]
    rows += [(days[0], "INE000000007", "B", "BE", 5.0, 5.0, 1.0, 5.0)]
    df = frame(rows, "date date, isin string, symbol string, series string, open double, close double, volume double, turnover double")
    acts = act.parse_action_factor(frame([("GONE00000001", "A", days[2], "Bonus 1:1")], "isin string, symbol string, ex_date date, subject string"))
    out = {(r["entity"], r["date"]): r["close"] for r in hyg.build_panel(df, acts).panel.collect()}
    assert [out[("INE000000001", d)] for d in days] == [50.0, 51.0, 51.0, 52.0, 53.0]
    assert [out[("INE000000009", d)] for d in days] == [None, None, 9.9, 10.0, 10.1]
    assert len(out) == 10
