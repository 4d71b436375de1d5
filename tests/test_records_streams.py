"""Record scoring, limits and the streaming behaviour."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import audits as ad
from tapeloom.operators import features as ft
from tapeloom.operators import records as rc
from tapeloom.streaming import bars as sb
from tapeloom.streaming import halts, sinks

D = dt.date


def record(frame, nets, **over):
    base = {"trades": 3, "wins": 1, "modelled_slippage": 10.0, "observed_slippage": 8.0, "slippage_source": "market", "loss_limit": 800.0}
    base.update(over)
    rows = [(D(2026, 1, 1) + dt.timedelta(days=i), float(n), *base.values()) for i, n in enumerate(nets)]
    return frame(rows, "trade_date date, net_pnl double, trades long, wins long, modelled_slippage double, observed_slippage double, slippage_source string, loss_limit double")


def checks(df, now="2026-01-26"):
    return {r["check"]: r["ok"] for r in rc.evidence_scorecard(df, now).collect()}


def test_scorecard_failures_one_by_one(frame):
    good = [200.0, -100.0] * 13
    assert all(checks(record(frame, good)).values())
    assert not checks(record(frame, good[:5]))["sessions"]
    assert not checks(record(frame, [-x for x in good]))["net_profitability"]
    assert not checks(record(frame, good, slippage_source="modelled"))["slippage_fidelity"]
    assert not checks(record(frame, good, observed_slippage=20.0))["slippage_fidelity"]
    assert not checks(record(frame, good[:-1] + [-900.0]))["daily_limit_respected"]
    assert not checks(record(frame, good), "2026-03-01")["freshness"]


def test_waivers(frame):
    c = frame([("sessions", False, 1.0), ("freshness", False, 1.0), ("trades", True, 1.0), ("profit_factor", False, 1.0)], "check string, ok boolean, value double")
    w = frame([("sessions", "read it"), ("freshness", "read it"), ("trades", "x"), ("profit_factor", " ")], "check string, waiver_reason string")
    got = {r["check"]: r["status"] for r in rc.waiver_apply(c, w).collect()}
    assert got == {"sessions": "WAIVED", "freshness": "REFUSED", "trades": "PASS", "profit_factor": "REFUSED"}


def test_peak_drawdown(frame):
    last = rc.peak_drawdown_limit(record(frame, [5000] + [-500] * 9), 40000.0, 10.0).orderBy(F.col("trade_date").desc()).first()
    assert (last["peak"], last["equity"], last["drawdown"], last["tripped"]) == (5000.0, 500.0, 4500.0, True)


def test_limit_audit_finds_streaks_and_late_entries(frame):
    day = D(2026, 1, 1)
    nets = [100, -10, -10, -10, 5, -900, 50]
    rows = [(day, i, 10 * i, 10 * i + 5, float(n)) for i, n in enumerate(nets)]
    r = rc.session_limit_audit(frame(rows, "trade_date date, trade_id long, open_min long, close_min long, net_pnl double"),
                               rc.LimitParams(800.0, 1200.0, 4, 5)).first()
    assert (r["longest_losing_streak"], r["beyond_cap"], r["halt_min"], r["halt_kind"], r["opened_after_halt"]) == (3, 2, 55, "loss_limit", 1)


def test_fingerprint_sees_cancelling_rows(frame):
    a = record(frame, [1.0, 2.0])
    twice = a.unionByName(a).unionByName(a)
    cols = ["trade_date", "net_pnl"]
    x, y = rc.record_fingerprint(a, cols).first(), rc.record_fingerprint(twice, cols).first()
    assert x["digest_xor"] == y["digest_xor"] and x["digest_sum"] != y["digest_sum"]


def test_weekend_only_ranges_are_not_failures(frame):
    lines = ["t ERROR TCS D 2024-01-06..2024-01-07 DH-905", "t ERROR TCS D 2024-01-06..2024-01-08 DH-905", "t ERROR TCS D no range"]
    got = ad.repeat_failures(frame([(x,) for x in lines], "line string"), 1).first()
    assert (got["symbol"], got["failures"]) == ("TCS", 2)


def test_leak_is_visible(frame):
    rows = [("A" if i % 2 else "B", i) for i in range(2)]
    ranked = frame([(D(2020, 1, d), s, float(v), float(-v)) for d in (1, 2) for s, v in zip("ABCDEF", range(6))], "date date, symbol string, pred double, y double").withColumn("fold", F.lit(1))
    got = ft.rank_ic_deciles(ranked, 5).collect()
    assert rows and all(r["ic"] == pytest.approx(-1.0) and r["top"] == -5.0 and r["bottom"] == 0.0 for r in got)


TICK = "symbol string, ts timestamp, event_id long, px double, qty double"


def feed(spark, path, rows):
    spark.createDataFrame([(s, dt.datetime(2026, 1, 1, h, m), i, float(p), 1.0) for s, h, m, i, p in rows], TICK).write.mode("append").parquet(path)
    return sb.tick_stream(spark, path, spark.read.parquet(path).schema)


def test_bars_appear_once_closed_and_late_ticks_are_counted(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    sb.run_available(sb.stream_bars(feed(spark, src, [("A", 9, 0, 1, 10), ("A", 9, 4, 2, 12), ("A", 9, 6, 3, 11)]), "5 minutes"), out, cp)
    first = spark.read.parquet(out).collect()
    assert [(r["open"], r["close"], r["volume"]) for r in first] == [(10.0, 12.0, 2.0)]
    q = sb.run_available(sb.stream_bars(feed(spark, src, [("A", 9, 1, 4, 99), ("A", 9, 20, 5, 13)]), "5 minutes"), out, cp)
    assert sb.late_rows_dropped(q) == 1
    assert sorted(r["close"] for r in spark.read.parquet(out).collect()) == [11.0, 12.0]


def test_halt_stays_until_acknowledged(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "account string, trade_date date, kind string, value double"
    seen = []
    for rows in ([("a", D(2026, 1, 1), "net", 100.0), ("a", D(2026, 1, 2), "net", -400.0)], [("a", D(2026, 1, 3), "net", 350.0)],
                 [("a", D(2026, 1, 4), "ack", 0.0), ("a", D(2026, 1, 5), "net", 1.0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        sb.run_available(halts.stream_sticky_halt(spark.readStream.schema(schema).parquet(src), 300.0), out, cp)
    seen = [r["tripped"] for r in spark.read.parquet(out).orderBy("trade_date").collect()]
    assert seen == [False, True, True, False, False]


def test_record_sink_replaces_a_date(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "trade_date date, net double, written_at long"
    sink = sinks.RecordSink(str(tmp_path / "table"))
    for rows in ([(D(2026, 1, 1), 1.0, 1), (D(2026, 1, 2), 2.0, 1)], [(D(2026, 1, 2), 5.0, 2)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        sinks.run_batches(spark.readStream.schema(schema).parquet(src), sink, cp)
    got = {r["trade_date"].day: r["net"] for r in sink.read(spark).collect()}
    assert got == {1: 1.0, 2: 5.0}
