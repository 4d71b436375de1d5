"""State machines with timers: several batches, a restart from the checkpoint, and plain Python as the twin."""

import datetime as dt

import pytest

from tapeloom.streaming import states as st
from tapeloom.streaming.bars import tick_stream

SCHEMA = "symbol string, ts timestamp, px double, qty double"


def at(day, hour, minute=0, second=0):
    return dt.datetime(2026, 3, day, hour, minute, second)


def batches(spark, tmp_path, stream, *batches):
    """Rows that each batch of ticks adds; every batch is a query of its own that goes on from the checkpoint."""
    seen, added = [], []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = stream(tick_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema))
        st.run_states(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        now = [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]
        left = list(now)
        for r in seen:
            left.remove(r)
        added.append(sorted(left, key=str))
        seen = now
    return added


def test_sessions_run_and_close_at_square_off(spark, tmp_path):
    first = [("a", at(2, 10), 10.0, 1.0), ("a", at(2, 11), 13.0, 2.0), ("b", at(2, 10), 5.0, 0.0)]
    second = [("a", at(2, 12), 9.0, 1.0), ("b", at(2, 14, 59, 58), 7.0, 0.0), ("a", at(2, 16), 99.0, 5.0)]
    third = [("b", at(2, 14), 1.0, 1.0), ("c", at(3, 9), 1.0, 1.0)]
    one, two, three = batches(spark, tmp_path, lambda t: st.stream_sessions(t, 15 * 60), first, second, third)
    day = dt.date(2026, 3, 2)
    assert one == [("a", day, "running", 12.0, 13.0, 10.0, 3.0, 2, at(2, 11)), ("b", day, "running", 5.0, 5.0, 5.0, 0.0, 1, at(2, 10))]
    assert two == [("a", day, "final", 11.25, 13.0, 9.0, 4.0, 3, at(2, 12)), ("a", day, "running", 11.25, 13.0, 9.0, 4.0, 3, at(2, 12)),
                   ("b", day, "final", 6.0, 7.0, 5.0, 0.0, 2, at(2, 14, 59, 58)), ("b", day, "running", 6.0, 7.0, 5.0, 0.0, 2, at(2, 14, 59, 58))]
    assert three == [("c", dt.date(2026, 3, 3), "running", 1.0, 1.0, 1.0, 1.0, 1, at(3, 9))]  # the late tick of b is dropped


def test_silence_is_told_while_others_print_and_ends(spark, tmp_path):
    first = [("a", at(2, 10), 1.0, 1.0), ("b", at(2, 10, 20), 1.0, 1.0), ("a", at(2, 10, 25), 1.0, 1.0)]
    second = [("b", at(2, 10, 40), 1.0, 1.0), ("b", at(2, 10, 56), 1.0, 1.0)]
    third = [("a", at(2, 11, 10), 1.0, 1.0), ("b", at(2, 11, 11), 1.0, 1.0)]
    one, two, three = batches(spark, tmp_path, lambda t: st.stream_silence(t, "30 minutes"), first, second, third)
    assert one == []
    assert two == [("a", "silent", at(2, 10, 55), at(2, 10, 25), 2)]
    assert three == [("a", "back", at(2, 11, 10), None, 0)]


@pytest.mark.parametrize("gap", [600, 1800])
def test_stretches_of_one_batch_equal_plain_python(spark, tmp_path, gap):
    import random
    rng = random.Random(gap)
    ticks = sorted((rng.choice("abc"), at(2, 0) + dt.timedelta(seconds=rng.randint(0, 80000))) for _ in range(200))
    (rows,) = batches(spark, tmp_path, lambda t: st.stream_silence(t, f"{gap} seconds"), [(s, t, 1.0, 1.0) for s, t in ticks])
    end, want = max(t for _, t in ticks) - dt.timedelta(seconds=5), []
    for symbol in "abc":
        last, many = None, 0
        for t in [t for s, t in ticks if s == symbol] + [dt.datetime.max - dt.timedelta(1)]:
            if last is not None and t - last >= dt.timedelta(seconds=gap):
                over = last + dt.timedelta(seconds=gap)
                want += [(symbol, "silent", over, last, many)] if over <= end else []
                want += [(symbol, "back", t, last, 0)] if t.year < 9000 else []
                many = 0
            last, many = t, many + 1
    assert sorted(rows, key=str) == sorted(want, key=str) and any(r[1] == "back" for r in rows)
