"""Keyed state machines with event-time timers: running session values until square-off, and symbols that fall silent.

State is one small row per key (a session's sums; a symbol's open stretches of activity), kept in the RocksDB state
store, so it lives outside the heap and survives a restart from the checkpoint. Timers fire on the watermark of the
whole stream: a symbol without ticks is judged by the ticks of all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.streaming.bars import GRACE, run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "symbol {0}, trade_date date, kind string, vwap double, session_high double, session_low double, volume double, ticks long, as_of timestamp"
SILENCE = "symbol {0}, kind string, at timestamp, last_tick timestamp, ticks long"


def _ms(ts: pd.Timestamp) -> int:
    """Milliseconds since the epoch, rounded up."""
    return -(-ts.value // 1_000_000)


class SessionState(StatefulProcessor):
    """Sums of one symbol's session. Every batch with ticks gives a running row; the timer at square-off gives the final one."""

    def __init__(self, square_off_minute: int):
        self.minute = square_off_minute

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "pv double, volume double, px double, ticks long, high double, low double, as_of long")

    def _row(self, key: tuple, kind: str, s: tuple) -> pd.DataFrame:
        pv, volume, px, ticks, high, low, as_of = s
        vwap = pv / volume if volume > 0 else px / ticks
        return pd.DataFrame({"symbol": [key[0]], "trade_date": [key[1]], "kind": [kind], "vwap": [vwap], "session_high": [high], "session_low": [low], "volume": [volume],
                             "ticks": [ticks], "as_of": [pd.Timestamp(as_of * 1000)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        close = pd.Timestamp(key[1]) + pd.Timedelta(minutes=self.minute)
        old = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0.0, 0, float("-inf"), float("inf"), 0)
        pv, volume, px, ticks, high, low, as_of = old
        before = ticks
        for pdf in rows:
            pdf = pdf[pdf["ts"] < close]
            if len(pdf):
                pv, volume, px, ticks = pv + float((pdf["px"] * pdf["qty"]).sum()), volume + float(pdf["qty"].sum()), px + float(pdf["px"].sum()), ticks + len(pdf)
                high, low, as_of = max(high, float(pdf["px"].max())), min(low, float(pdf["px"].min())), max(as_of, pdf["ts"].max().value // 1000)
        if ticks > before:
            state = (pv, volume, px, ticks, high, low, as_of)
            self.sums.update(state)
            if not before:
                self.handle.registerTimer(_ms(close))
            yield self._row(key, "running", state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.sums.get()
        self.sums.clear()
        yield self._row(key, "final", state)

    def close(self) -> None:
        pass


def stream_sessions(ticks: DataFrame, square_off_minute: int = 24 * 60, grace: str = GRACE) -> DataFrame:
    """Per symbol and day: after every batch the values so far, and once the watermark passes square-off the final ones.

    Ticks from square-off on count for nothing. ``ticks``: symbol, ts, px, qty.
    """
    keyed = ticks.withWatermark("ts", grace).select("symbol", F.to_date("ts").alias("trade_date"), "ts", "px", "qty")
    schema = SESSION.format(ticks.schema["symbol"].dataType.simpleString())
    return keyed.groupBy("symbol", "trade_date").transformWithStateInPandas(SessionState(square_off_minute), schema, "append", "eventTime")


class SilenceState(StatefulProcessor):
    """Open stretches of one symbol's ticks, none of them as much as ``gap`` apart from the next tick inside.

    Each tick lengthens its stretch and so puts off the timer at the stretch's end; a timer that fires reports the symbol
    silent from then on, and the first tick after a silence is reported as back.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretches = handle.getValueState("stretches", "begin array<long>, last array<long>, ticks array<long>, silent boolean")

    def _load(self) -> tuple[list[tuple[int, int, int]], bool]:
        if not self.stretches.exists():
            return [], False
        begin, last, ticks, silent = self.stretches.get()
        return list(zip(map(int, begin), map(int, last), map(int, ticks), strict=True)), bool(silent)

    def _save(self, stretches: list[tuple[int, int, int]], silent: bool) -> None:
        self.stretches.update(([s[0] for s in stretches], [s[1] for s in stretches], [s[2] for s in stretches], silent))

    def _row(self, key: tuple, kind: str, at: int, last: int | None, ticks: int) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]], "kind": [kind], "at": [pd.Timestamp(at * 1000)], "last_tick": [pd.NaT if last is None else pd.Timestamp(last * 1000)], "ticks": [ticks]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, silent = self._load()
        old = {begin for begin, _, _ in known}
        parts = [*known]
        for pdf in rows:
            parts += [(t, t, 1) for t in (pdf["ts"].astype("int64") // 1000 if pdf["ts"].dtype == "datetime64[ns]" else pdf["ts"].astype("datetime64[us]").astype("int64")).tolist()]
        merged: list[tuple[int, int, int]] = []
        for begin, last, ticks in sorted(parts):
            if merged and begin < merged[-1][1] + self.gap:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] + ticks)
            else:
                merged.append((begin, last, ticks))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for i, (begin, last, _) in enumerate(merged):
            self.handle.registerTimer(-(-(last + self.gap) // 1000))
            if begin not in old and (i or silent):
                yield self._row(key, "back", begin, merged[i - 1][1] if i else None, 0)
        self._save(merged, silent)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stretches, silent = self._load()
        over = [s for s in stretches if -(-(s[1] + self.gap) // 1000) <= expiredTimerInfo.getExpiryTimeInMs()]
        for _, last, ticks in over:
            yield self._row(key, "silent", last + self.gap, last, ticks)
        self._save([s for s in stretches if s not in over], silent or bool(over))

    def close(self) -> None:
        pass


def stream_silence(ticks: DataFrame, gap: str, grace: str = GRACE) -> DataFrame:
    """A row ``silent`` (from ``at``, after ``ticks`` ticks) for every symbol without a tick for ``gap`` of event time, and a
    row ``back`` at its next tick. ``ticks``: symbol, ts."""
    keyed = ticks.withWatermark("ts", grace).select("symbol", "ts")
    schema = SILENCE.format(ticks.schema["symbol"].dataType.simpleString())
    return keyed.groupBy("symbol").transformWithStateInPandas(SilenceState(pd.Timedelta(gap).value // 1000), schema, "append", "eventTime")


def run_states(stream: DataFrame, out: str, checkpoint: str):
    """``run_available`` with the state store that timers need; the session's setting is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return run_available(stream, out, checkpoint)
    finally:
        conf.set(PROVIDER, before)
