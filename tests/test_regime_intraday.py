"""Regimes, rules, routing, fills and exits on tiny sessions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import calendars as cal
from tapeloom.operators import intraday as idy
from tapeloom.operators import outcomes as oc
from tapeloom.operators import regime as rg

D, T0 = dt.date, dt.datetime(2026, 8, 28, 9, 15)
BAR = "symbol string, trade_date date, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"


def session(frame, bars, symbol="A"):
    return frame([(symbol, T0.date(), T0 + dt.timedelta(minutes=5 * i), *map(float, b)) for i, b in enumerate(bars)], BAR)


def test_sine_benchmark_is_never_a_trend(frame):
    rows = [(i + 1, D(2020, 1, 1) + dt.timedelta(days=i), 1000 + 20 * math.sin(i / 2), 1003 + 20 * math.sin(i / 2), 997 + 20 * math.sin(i / 2)) for i in range(400)]
    t = rg.regime_table(frame(rows, "session_no int, date date, close double, high double, low double"))
    assert t.filter("family = 'trend'").count() == 0 and t.count() == 400 - 204


def test_vwap_weights_by_volume_and_falls_back(frame):
    px = [(p, p, p, p, v) for p, v in zip([100, 100, 100, 200], [1, 1, 1, 97])]
    last = session(frame, px).withColumn("v", idy.session_vwap()).orderBy(F.col("bar_ts").desc()).first()
    assert last["v"] > 190
    none = session(frame, [(p, p, p, p, 0) for p in (100, 110)]).withColumn("v", idy.session_vwap()).orderBy(F.col("bar_ts").desc()).first()
    assert none["v"] == pytest.approx(105.0)


SIG = "symbol string, trade_date date, bar_ts timestamp_ntz, side string, entry double, stop double, target double, strategy string, confidence double, rule_no int"


def signals(frame, rows):
    at = T0 + dt.timedelta(minutes=30)
    return frame([("A", T0.date(), at, *r, i) for i, r in enumerate(rows)], SIG)


def test_contradicting_rules_cancel(frame):
    s = signals(frame, [("long", 100.0, 99.0, 103.0, "X", .5), ("short", 100.0, 101.0, 97.0, "Y", .5)])
    assert idy.route_signals(s, idy.SessionTimes()).count() == 0


def test_agreeing_rules_merge(frame):
    s = signals(frame, [("long", 100.0, 97.0, 110.0, "X", .4), ("long", 100.0, 99.0, 104.0, "Y", .4)])
    r = idy.route_signals(s, idy.SessionTimes()).first()
    assert (r["stop"], r["target"], r["strategy"], r["rules"]) == (99.0, 104.0, "X+Y", 2) and r["confidence"] == pytest.approx(0.64)


def test_invalid_merge_falls_back_to_the_best_rule(frame):
    s = signals(frame, [("long", 100.0, 97.0, 110.0, "X", .4), ("long", 120.0, 115.0, 130.0, "Y", .3)])
    r = idy.route_signals(s, idy.SessionTimes()).first()
    assert (r["entry"], r["stop"], r["strategy"]) == (100.0, 97.0, "X")


def test_duplicate_rule_names_are_refused():
    reg = idy.default_registry()
    with pytest.raises(ValueError):
        reg.register(idy.vwap_pullback_rule())
    assert {r.name for r in reg.for_family("range")} == {"VWAPReversion", "GapFade"}


def test_next_bar_fill_and_stop_first(frame):
    bars = session(frame, [(100, 101, 99, 100, 10)] * 7 + [(100.5, 101, 100, 100.5, 10), (101, 105, 98, 102, 10), (102, 103, 101, 102, 10)])
    s = signals(frame, [("long", 100.0, 99.0, 104.0, "X", .5)])
    f = oc.next_bar_fill(s, bars, 5.0)
    r = f.first()
    assert r["fill_ref"] == 100.5 and r["fill_price"] == pytest.approx(100.5 * 1.0005)
    x = oc.first_touch_exit(f, bars, idy.SessionTimes()).first()
    assert (x["reason"], x["exit_ref"]) == ("stop", 99.0)


def test_open_through_the_stop_never_fills(frame):
    bars = session(frame, [(100, 101, 99, 100, 10)] * 7 + [(98, 99, 97, 98, 10)])
    assert oc.next_bar_fill(signals(frame, [("long", 100.0, 99.0, 104.0, "X", .5)]), bars).count() == 0


def test_last_bar_closes_what_nothing_touched(frame):
    bars = session(frame, [(100, 101, 99.5, 100, 10)] * 10)
    f = oc.next_bar_fill(signals(frame, [("long", 100.0, 95.0, 120.0, "X", .5)]), bars)
    x = oc.first_touch_exit(f, bars, idy.SessionTimes()).first()
    assert (x["reason"], x["exit_ref"]) == ("squareoff", 100.0)


def test_forming_bar_is_dropped(frame):
    bars = session(frame, [(100, 101, 99, 100, 10)] * 3)
    now = F.lit(T0 + dt.timedelta(minutes=14)).cast("timestamp_ntz")
    assert cal.confirmed_bars(bars, now, "5 minutes").count() == 2
    assert cal.confirmed_bars(bars, now + F.expr("interval 1 minute"), "5 minutes").count() == 3


def test_size_is_capped_and_explained(frame):
    df = frame([("long", 100.0, 99.0, 1e6), ("long", 100.0, 99.99, 1e6), ("long", 100.0, 60.0, 1e6), ("long", 5000.0, 4700.0, 1e6)], "side string, entry double, stop double, median_volume double")
    got = [(r["quantity"], r["binding_cap"], r["decision"]) for r in oc.size_columns(df).collect()]
    assert got[0] == (160, "risk_budget", "ok") and got[1][1] == "position_notional" and got[2][2] == "below notional floor" and got[3][2] == "budget"


def test_context_reads_strictly_earlier_days(frame):
    rows = [("A", D(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 5.0) for i in range(20)]
    daily = frame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double")
    got = {r["trade_date"].day: r["prev_close"] for r in idy.asof_strictly_before(daily, daily).collect()}
    assert got[16] is None and got[17] == 25.0 and got[20] == 28.0
