"""Exits and excursions by blocks against the plain joins, on random sessions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import outcomes as oc
from tapeloom.operators import touches as tc
from tapeloom.operators.intraday import SessionTimes

TIMES = SessionTimes()
T0 = dt.datetime(2026, 1, 5, 9, 15)


def session(rng, symbol, bars):
    px, out = 100.0, []
    for i in range(bars):
        px += rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
        out.append((symbol, T0.date(), T0 + dt.timedelta(minutes=5 * i), px, px + rng.choice([0.0, 0.5, 1.0]), px - rng.choice([0.0, 0.5, 1.0]), px, 10.0))
    return out


@pytest.mark.parametrize("block", [1, 4, 7, 500])
def test_blocks_equal_plain_joins(spark, frame, block):
    rng = random.Random(block)
    bars, orders = [], []
    for symbol in range(6):
        own = session(rng, symbol, rng.choice([1, 5, 33, 72]))
        bars += own
        for i, b in enumerate(own):
            far = rng.choice([0.5, 2.0, 6.0, 50.0])
            side = rng.choice(["long", "short"])
            sign = 1 if side == "long" else -1
            fill = own[min(i + 1, len(own) - 1)][2] + dt.timedelta(minutes=rng.choice([0, 0, 2]))
            orders.append((symbol, b[1], b[2], side, b[3] - sign * far, b[3] + sign * far, fill, b[3]))
    bars = frame(bars, "symbol long, trade_date date, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")
    orders = frame(orders, "symbol long, trade_date date, bar_ts timestamp_ntz, side string, stop double, target double, fill_ts timestamp_ntz, fill_price double")
    blocks = tc.blocks_of_bars(bars, TIMES, block)
    plain, fast = oc.first_touch_exit(orders, bars, TIMES), tc.first_touch_by_blocks(orders, blocks)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(plain) == key(fast) and len({r["reason"] for r in plain.collect()}) >= 2
    assert key(oc.excursion(plain, bars)) == key(tc.excursion_by_blocks(plain, blocks))


def test_index_is_one_row_a_session(spark, frame):
    """A session of 72 bars is one index row and nine blocks, of which a trade reads two at most."""
    bars = frame(session(random.Random(1), 1, 72), "symbol long, trade_date date, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double")
    blocks = tc.blocks_of_bars(bars, TIMES, 8)
    assert tc.block_index(blocks).count() == 1 and blocks.count() == 9 and blocks.agg(F.max(F.size("bars"))).first()[0] == 8
