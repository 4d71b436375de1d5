"""Indicators as columns over all series at once.

``recursive_means`` is the one place that needs Python: an exponential recursion is not a window aggregate. It is a scan
of affine maps over ranges of rows (``plans/scans.py``), so no series has to fit one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.frames import lookback, median_of, ratio, rolling
from tapeloom.functions.moving import Moving, moving_of_bars
from tapeloom.plans.scans import exponential_means, exponential_means_of_bars

SESSIONS_PER_YEAR = 252


def recursive_means(df: DataFrame, keys: Sequence[str], order: str, specs: Mapping[str, tuple[str, float, int]]) -> DataFrame:
    """Add exponential means x̄ₜ = x̄ₜ₋₁ + α(xₜ − x̄ₜ₋₁); ``specs``: name -> (column, α, values needed)."""
    return exponential_means(df, keys, order, specs)


def sma(col: str, length: int, *keys: str) -> Column:
    return rolling(F.avg(col), col, length, length, *keys)


def own(*keys: str, order: str = "session_no"):
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def true_range(*keys: str, order: str = "session_no") -> Column:
    prev = F.lag("close").over(own(*keys, order=order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_wilder(df: DataFrame, length: int = 14, keys: Sequence[str] = ("symbol",), order: str = "session_no",
               name: str = "atr") -> DataFrame:
    """The true range is a window by series, so the recursion streams through the partitions of that window."""
    ranged = df.withColumn("true_range", true_range(*keys, order=order))
    return exponential_means_of_bars(ranged, keys, order, {name: ("true_range", 1.0 / length, length)})


def ema(df: DataFrame, length: int, col: str = "close", keys: Sequence[str] = ("symbol",), order: str = "session_no",
        name: str = "ema") -> DataFrame:
    bars = df.withColumn("_bar", F.row_number().over(own(*keys, order=order)))  # a window, so that series lie whole
    return exponential_means_of_bars(bars, keys, order, {name: (col, 2.0 / (length + 1), 1)}).drop("_bar")


def slope_r2(y: Column, x: Column, frame, width: int, per_year: int = SESSIONS_PER_YEAR) -> Column:
    """Annualised exponential regression slope × R² over a full frame; a flat window fits exactly."""
    beta = F.regr_slope(y, x).over(frame)
    fit = F.least(F.coalesce(F.regr_r2(y, x).over(frame), F.lit(1.0)), F.lit(1.0))
    annual = F.exp(F.greatest(F.least(beta * per_year, F.lit(10.0)), F.lit(-10.0))) - 1
    return F.when(F.count(y).over(frame) == width, annual * fit)


def rolling_slope_r2(width: int, per_year: int = SESSIONS_PER_YEAR) -> Column:
    y = F.log(F.when(F.col("close") > 0, F.col("close")))
    return slope_r2(y, F.col("session_no"), own().rangeBetween(-(width - 1), 0), width, per_year)


def annualised(slope: Column, r2: Column, per_year: int = SESSIONS_PER_YEAR) -> Column:
    """Annualised exponential slope × R²; null where the window had gaps."""
    annual = F.exp(F.greatest(F.least(slope * per_year, F.lit(10.0)), F.lit(-10.0))) - 1
    return F.when(slope.isNotNull(), annual * F.least(r2, F.lit(1.0)))


def rolling_median_turnover(width: int) -> Column:
    t = F.col("close") * F.col("volume")
    return rolling(median_of(t), t, width, max(2, width // 2))


def with_median_turnover(df: DataFrame, width: int, name: str = "median_turnover", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Median turnover of the last ``width`` sessions, by a sliding sorted window."""
    traded = df.withColumn("_turnover", F.col("close") * F.col("volume"))
    return moving_of_bars(traded, {name: Moving("median", "_turnover", width, max(2, width // 2), by_order=True)}, keys).drop("_turnover")


def with_max_abs_gap(df: DataFrame, width: int, name: str = "max_gap") -> DataFrame:
    prev = lookback("close", 1)
    gap = F.abs((F.col("open") - prev) / F.when(prev > 0, prev))
    return (df.withColumn("_gap", gap)
            .withColumn(name, rolling(F.max("_gap"), "_gap", width, max(2, width // 2))).drop("_gap"))


def with_efficiency_ratio(df: DataFrame, width: int, name: str = "efficiency", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    w = own(*keys)
    step = df.withColumn("_d", F.abs(F.col("close") - F.lag("close").over(w)))
    path = F.sum("_d").over(w.rowsBetween(-(width - 1), 0))
    net = F.abs(F.col("close") - F.lag("close", width).over(w))
    return step.withColumn(name, F.when(path > 0, net / path)).drop("_d")


def rolling_percentile(col: str, width: int, least: int = 1, keys: Sequence[str] = ("symbol",)) -> Column:
    """Average-rank percentile (0..1) of the latest value inside its trailing window of ``width`` rows."""
    seen = F.collect_list(col).over(own(*keys).rowsBetween(-(width - 1), 0))
    below = F.size(F.filter(seen, lambda x: x < F.col(col)))
    same = F.size(F.filter(seen, lambda x: x == F.col(col)))
    return F.when(F.col(col).isNotNull() & (F.size(seen) >= least), (below + (same + 1) / 2) / F.size(seen))


def efficiency_percentile(col: str = "efficiency", width: int = 252, least: int = 60,
                          keys: Sequence[str] = ("symbol",)) -> Column:
    """Share (0..100) of earlier readings strictly below the current one; the current one is not in the sample."""
    seen = F.collect_list(col).over(own(*keys).rowsBetween(-width, -1))
    return F.when(F.col(col).isNotNull() & (F.size(seen) >= least),
                  100.0 * F.size(F.filter(seen, lambda x: x < F.col(col))) / F.size(seen))


def momentum(look: int = 252, skip: int = 21) -> Column:
    return ratio(lookback("close", skip), lookback("close", look)) - 1


def own_return(look: int, skip: int = 0) -> Column:
    """Return over ``look`` printed bars ending ``skip`` bars ago; null without a positive start."""
    w = own()
    end = F.lag("close", skip).over(w) if skip else F.col("close")
    start = F.lag("close", look + skip).over(w)
    return F.when(start > 0, end / start - 1)


@dataclass(frozen=True)
class FactorParams:
    short: int = 21
    medium: int = 63
    long: int = 126
    year: int = 252
    skip: int = 21
    atr: int = 14
    slope: int = 90
    efficiency: int = 63
    fast: int = 20
    slow: int = 100
    per_year: int = SESSIONS_PER_YEAR

    @property
    def min_bars(self) -> int:
        return self.year + self.skip + 5


def horizon_returns(df: DataFrame, p: FactorParams = FactorParams()) -> DataFrame:
    return df.withColumns({"ret_short": own_return(p.short), "ret_medium": own_return(p.medium),
                           "ret_long": own_return(p.long), "ret_year_skip": own_return(p.year - p.skip, p.skip)})


def range_gap_pct(df: DataFrame, p: FactorParams = FactorParams()) -> DataFrame:
    w = own()
    prev = F.lag("close").over(w)
    step = df.withColumns({"_rng": ratio(F.col("high") - F.col("low"), F.col("close")),
                           "_gp": ratio(F.abs(F.col("open") - prev), prev)})
    recent = w.rowsBetween(-(p.short - 1), 0)
    return step.withColumns({"range_pct": F.avg("_rng").over(recent), "gap_pct": F.avg("_gp").over(recent)}).drop("_rng", "_gp")


def liquidity_factors(df: DataFrame, p: FactorParams = FactorParams()) -> DataFrame:
    traded = df.withColumns({"_vol": F.coalesce("volume", F.lit(0.0)), "_turnover": F.col("close") * F.coalesce("volume", F.lit(0.0))})
    none = F.avg((F.col("_vol") <= 0).cast("double")).over(own().rowsBetween(-(p.slow - 1), 0))
    step = moving_of_bars(traded.withColumn("zero_volume_frac", none), {"_fast": Moving("median", "_turnover", p.fast), "median_turnover": Moving("median", "_turnover", p.slow), "median_volume": Moving("median", "_vol", p.slow)})
    grown = F.when(F.col("median_turnover") > 0, F.col("_fast") / F.col("median_turnover"))
    return step.withColumn("turnover_expansion", grown).drop("_fast", "_vol", "_turnover")


def compute_factors(bars: DataFrame, p: FactorParams = FactorParams()) -> DataFrame:
    """Factor row per (symbol, date) with enough history and a positive close.

    Every column reads only bars up to the row. Steps between bars are windows of one partitioning and sort, the recursion
    streams through the same partitions, and all trailing statistics are taken in one pass over the laid-out bars.
    """
    w = own()
    prev, vol = F.lag("close").over(w), F.coalesce("volume", F.lit(0.0))
    laid = bars.withColumns({"bars": F.row_number().over(w).cast("long"), "true_range": true_range()})
    steps = horizon_returns(laid, p).withColumns({
        "_d": F.abs(F.col("close") - prev), "_net": F.abs(F.col("close") - F.lag("close", p.efficiency).over(w)),
        "_rng": ratio(F.col("high") - F.col("low"), F.col("close")), "_gp": ratio(F.abs(F.col("open") - prev), prev),
        "_vol": vol, "_turnover": F.col("close") * vol, "_none": (vol <= 0).cast("double"),
        "_y": F.log(F.when(F.col("close") > 0, F.col("close")))}).drop("open", "high", "low", "volume", "turnover")
    ranged = exponential_means_of_bars(steps, ["symbol"], "session_no", {"atr": ("true_range", 1.0 / p.atr, p.atr)}).drop("true_range")
    cols = moving_of_bars(ranged, {
        "_path": Moving("sum", "_d", p.efficiency), "range_pct": Moving("mean", "_rng", p.short), "gap_pct": Moving("mean", "_gp", p.short),
        "_fast": Moving("median", "_turnover", p.fast), "median_turnover": Moving("median", "_turnover", p.slow),
        "median_volume": Moving("median", "_vol", p.slow), "zero_volume_frac": Moving("mean", "_none", p.slow),
        "_slope": Moving("slope", "_y", p.slope), "_r2": Moving("r2", "_y", p.slope)}, bars="bars")
    ranked = cols.filter((F.col("bars") >= p.min_bars) & (F.col("close") > 0))
    return ranked.withColumns({
        "efficiency_ratio": F.when(F.col("_path") > 0, F.col("_net") / F.col("_path")),
        "turnover_expansion": F.when(F.col("median_turnover") > 0, F.col("_fast") / F.col("median_turnover")),
        "slope_r2": annualised(F.col("_slope"), F.col("_r2"), p.per_year), "atr_pct": F.col("atr") / F.col("close"),
    }).drop("atr", *[c for c in cols.columns if c.startswith("_")])


def drawdown_curve(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str = "drawdown") -> DataFrame:
    top = F.max(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, ratio(F.col(value), top) - 1)


def rsi(df: DataFrame, length: int = 14, name: str = "rsi") -> DataFrame:
    """Wilder relative strength index; 100 when there were no losses."""
    move = F.col("close") - F.lag("close").over(own())
    step = df.withColumns({"_up": F.greatest(move, F.lit(0.0)), "_dn": F.greatest(-move, F.lit(0.0))})
    step = step.withColumns({c: F.when(move.isNotNull(), F.col(c)) for c in ("_up", "_dn")})
    s = recursive_means(step, ["symbol"], "session_no", {"_au": ("_up", 1 / length, length), "_ad": ("_dn", 1 / length, length)})
    value = F.when(F.col("_ad") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_au") / F.nullif("_ad", F.lit(0.0))))
    return s.withColumn(name, F.when(F.col("_au").isNotNull(), value)).drop("_up", "_dn", "_au", "_ad")


def bollinger(df: DataFrame, length: int = 20, width: float = 2.0) -> DataFrame:
    frame = own().rowsBetween(-(length - 1), 0)
    full = F.count("close").over(frame) >= length
    mid, sd = F.avg("close").over(frame), F.stddev_samp("close").over(frame)
    return df.withColumns({"bb_mid": F.when(full, mid), "bb_upper": F.when(full, mid + width * sd),
                           "bb_lower": F.when(full, mid - width * sd)})


def realised_vol(df: DataFrame, length: int = 20, per_year: int = SESSIONS_PER_YEAR, name: str = "realised_vol") -> DataFrame:
    step = df.withColumn("_lr", F.log(ratio(F.col("close"), F.lag("close").over(own()))))
    frame = own().rowsBetween(-(length - 1), 0)
    vol = F.stddev_samp("_lr").over(frame) * F.sqrt(F.lit(float(per_year)))
    return step.withColumn(name, F.when(F.count("_lr").over(frame) >= length, vol)).drop("_lr")
