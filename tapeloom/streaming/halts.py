"""A drawdown halt that trips once and stays until it is acknowledged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "account string, trade_date date, kind string, equity double, peak double, drawdown double, tripped boolean"
STATE = "equity double, peak double, tripped boolean, last date"


def stream_sticky_halt(events: DataFrame, limit: float) -> DataFrame:
    """``events``: account, trade_date, kind (net / ack), value; at most one net row per account and day.

    An acknowledgement clears a standing halt; the next net row trips it again while the drawdown is still at the
    limit. Rows of one batch are taken in date order, an acknowledgement after that day's result. A row dated before the
    last day that an earlier batch brought is not folded in: it comes out as kind ``late`` with the standing figures.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, peak, tripped, last = state.get if state.exists else (0.0, 0.0, False, None)
        rows = pd.concat(list(frames)).sort_values(["trade_date", "kind"], ascending=[True, False], ignore_index=True)
        late = (rows["trade_date"] < last).to_numpy(bool) if last is not None else np.zeros(len(rows), bool)
        net, ack = (rows["kind"] == "net").to_numpy() & ~late, (rows["kind"] == "ack").to_numpy() & ~late
        value = np.where(net, rows["value"].to_numpy(np.float64), 0.0)
        run = np.cumsum(np.concatenate([[equity], value]))[1:]
        high = np.maximum.accumulate(np.concatenate([[peak], np.where(net, run, -np.inf)]))[1:]
        stretch = np.cumsum(ack)
        hit = pd.Series(net & (high - run >= limit)).groupby(stretch).cummax().to_numpy(bool)
        state_of = hit | ((stretch == 0) & tripped)
        if len(rows):
            state.update((float(run[-1]), float(high[-1]), bool(state_of[-1]), rows["trade_date"].iloc[-1] if last is None else max(last, rows["trade_date"].iloc[-1])))
        yield pd.DataFrame({"account": key[0], "trade_date": rows["trade_date"], "kind": np.where(late, "late", rows["kind"]), "equity": run, "peak": high,
                            "drawdown": high - run, "tripped": state_of})

    return events.groupBy("account").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
