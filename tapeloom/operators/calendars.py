"""Row selection, deduplication and calendars over bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.plans.ordered import last_known

# Fixed value: symbols the exchange lists for its own tests.
TEST_SYMBOL = "NSETEST"


def candidate_filter(listing: DataFrame, series: Sequence[str] = ("EQ",), exchange: str = "NSE", segment: str = "E",
                     instrument: str = "EQUITY") -> DataFrame:
    """Tradable instruments of a listing: first row per security id (by ``position``), test symbols removed."""
    def clean(c: str) -> Column:
        return F.upper(F.trim(c))
    pool = listing.filter((clean("exchange") == exchange) & (clean("segment") == segment)
                          & (clean("instrument") == instrument)
                          & clean("series").isin([s.upper() for s in series]))
    keyed = pool.select(F.split("security_id", r"\.")[0].alias("security_id"), clean("symbol").alias("symbol"),
                        "position")
    first = keyed.groupBy("security_id").agg(F.min_by("symbol", "position").alias("symbol"))
    return first.filter(~F.col("symbol").contains(TEST_SYMBOL))


def series_filter(df: DataFrame, series: Sequence[str] = ("EQ",)) -> DataFrame:
    return df.filter(F.col("series").isin(list(series)))


def dedupe_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``; a key with very many copies is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*")


def panel_min_history(bars: DataFrame, min_bars: int) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return bars.withColumn("_n", n).filter(F.col("_n") >= min_bars).drop("_n")


def live_session_filter(bars: DataFrame, fraction: float = 0.30) -> DataFrame:
    """Keep sessions on which at least ``fraction`` of all names printed."""
    names = bars.select(F.countDistinct("symbol").alias("names"))
    per = bars.groupBy("date").agg(F.count("close").alias("printed"))
    live = per.filter(F.col("printed") >= fraction * names.scalar()).select("date")
    return bars.join(F.broadcast(live), "date", "left_semi")


def panel_slice(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def align_calendar(bars: DataFrame, fields: Sequence[str] = ("close",)) -> DataFrame:
    """Every name on every session of the shared calendar; sessions without a bar hold nulls.

    Each name explodes the session numbers itself, so no cross join is planned.
    """
    last = bars.select(F.max("session_no"))
    calendar = bars.select("session_no", "date").distinct()
    grid = bars.select("symbol").distinct().select(
        "symbol", F.explode(F.sequence(F.lit(1), last.scalar())).alias("session_no"))
    dated = grid.join(F.broadcast(calendar), "session_no")
    return dated.join(bars.select("symbol", "session_no", *fields), ["symbol", "session_no"], "left")


def mark_ffill(aligned: DataFrame, col: str = "close", name: str = "mark") -> DataFrame:
    """Last known value for marking; never an input to a decision."""
    return last_known(aligned, ["symbol"], ["session_no"], {name: col})


def derive_turnover(bars: DataFrame) -> DataFrame:
    return bars.withColumn("turnover", F.col("close") * F.col("volume"))


def session_split(bars: DataFrame, open_time: str, close_time: str, min_bars: int = 10) -> DataFrame:
    """Bars inside the session's clock window, only of symbol-days with enough of them."""
    clock = F.date_format("bar_ts", "HH:mm")
    inside = bars.filter(clock.between(open_time, close_time))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "trade_date"))
    return inside.withColumn("_n", n).filter(F.col("_n") >= min_bars).drop("_n")


def session_dates(bars: DataFrame) -> DataFrame:
    return bars.select("trade_date").distinct()


def confirmed_bars(bars: DataFrame, now: Column, length: str = "1 hour") -> DataFrame:
    """Bars whose whole interval lies at or before ``now``."""
    return bars.filter(F.col("bar_ts") <= now - F.expr(f"interval {length}"))


def round_tick(price: Column, tick: float = 0.05) -> Column:
    return F.round(F.rint(price / tick) * tick, 2)


def first_tradeable_date(flags: DataFrame) -> DataFrame:
    """First session with an investable name on which the market filter is known."""
    return flags.filter(F.col("investable") & F.col("market_ok").isNotNull()).agg(F.min("date").alias("date"))
