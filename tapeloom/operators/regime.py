"""Market regime of every session from the benchmark series and breadth.

The benchmark has one row per session, so its windows and its exponential scan are bounded by the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions.frames import ratio

BREADTH_BULL, BREADTH_BEAR = 0.55, 0.45
EFFICIENCY_FLOOR = 0.10
EFFICIENCY_PERCENTILE = 65.0


@dataclass(frozen=True)
class RegimeParams:
    fast: int = 20
    slow: int = 50
    anchor: int = 200
    atr: int = 14
    high_vol_percentile: float = 80.0
    percentile_window: int = 252
    least_atr: int = 30
    least_efficiency: int = 60

    @property
    def need(self) -> int:
        return max(self.anchor, self.atr) + 5


def evidence(bench: DataFrame, breadth: DataFrame | None, p: RegimeParams = RegimeParams()) -> DataFrame:
    """Averages, volatility and efficiency with their own percentiles, per session."""
    b = bench.withColumn("symbol", F.lit("INDEX"))
    b = b.withColumns({"bars": F.row_number().over(ind.own()).cast("long"), "sma_anchor": ind.sma("close", p.anchor),
                       "true_range": ind.true_range()})
    b = ind.recursive_means(b, ["symbol"], "session_no", {
        "ema_fast": ("close", 2 / (p.fast + 1), 1), "ema_slow": ("close", 2 / (p.slow + 1), 1),
        "_atr": ("true_range", 1 / p.atr, p.atr)})
    b = ind.with_efficiency_ratio(b.withColumn("atr_pct", ratio(F.col("_atr"), F.col("close"))), p.slow)
    b = b.withColumns({"atr_percentile": 100 * ind.rolling_percentile("atr_pct", p.percentile_window, p.least_atr),
                       "efficiency_percentile": ind.efficiency_percentile("efficiency", p.percentile_window, p.least_efficiency)})
    b = b.drop("symbol", "true_range", "_atr")
    if breadth is None:
        return b.withColumn("breadth", F.lit(None).cast("double"))
    return b.join(F.broadcast(breadth.select("session_no", "breadth")), "session_no", "left")


def with_direction(e: DataFrame, p: RegimeParams = RegimeParams()) -> DataFrame:
    """Votes of anchor, averages and breadth; two agreeing votes decide."""
    def vote(up, down):
        return F.when(up, 1).when(down, -1).otherwise(0)
    score = (vote(F.col("close") > F.col("sma_anchor"), F.col("close") < F.col("sma_anchor"))
             + vote(F.col("ema_fast") > F.col("ema_slow"), F.col("ema_fast") < F.col("ema_slow"))
             + vote(F.col("breadth") >= BREADTH_BULL, F.col("breadth") <= BREADTH_BEAR))
    scored = e.withColumn("votes", score)
    return scored.withColumn("direction", F.when(F.col("votes") >= 2, 1).when(F.col("votes") <= -2, -1).otherwise(0))


def with_family(e: DataFrame, p: RegimeParams = RegimeParams()) -> DataFrame:
    """Volatility first, then the absolute and relative efficiency tests."""
    eff, pct = F.col("efficiency"), F.col("efficiency_percentile")
    return e.withColumn("family", F.when(F.col("atr_percentile") >= p.high_vol_percentile, "volatile")
                        .when(eff.isNull() | (eff < EFFICIENCY_FLOOR), "range")
                        .when(pct < EFFICIENCY_PERCENTILE, "range").otherwise("trend"))


def with_confidence(e: DataFrame) -> DataFrame:
    """Mean agreement of the votes, the spread of the averages and efficiency, in 0..1."""
    gap = F.abs(F.col("ema_fast") - F.col("ema_slow")) / F.greatest(F.abs("ema_slow"), F.lit(1e-9)) / 0.02
    own = F.when(F.col("efficiency_percentile").isNotNull(), F.col("efficiency_percentile") / 100) \
        .when(F.col("efficiency").isNotNull(), F.least(F.col("efficiency") / 0.6, F.lit(1.0))).otherwise(F.lit(0.0))
    mean = (F.abs("votes") / 3 + F.least(gap, F.lit(1.0)) + own) / 3
    return e.withColumn("confidence", F.greatest(F.least(mean, F.lit(1.0)), F.lit(0.0)))


def regime_table(bench: DataFrame, breadth: DataFrame | None = None, p: RegimeParams = RegimeParams()) -> DataFrame:
    """One row per session with enough history: evidence, label, permitted sides and reasons."""
    t = with_confidence(with_family(with_direction(evidence(bench, breadth, p), p), p)).filter(F.col("bars") >= p.need)
    word = F.when(F.col("direction") > 0, "bull").when(F.col("direction") < 0, "bear").otherwise("neutral")
    reasons = F.array_compact(F.array(
        F.when(F.col("close") > F.col("sma_anchor"), f"close above {p.anchor}-session mean")
        .when(F.col("close") < F.col("sma_anchor"), f"close below {p.anchor}-session mean"),
        F.when(F.col("ema_fast") > F.col("ema_slow"), f"EMA{p.fast} above EMA{p.slow}")
        .when(F.col("ema_fast") < F.col("ema_slow"), f"EMA{p.fast} below EMA{p.slow}"),
        F.when(F.col("breadth") >= BREADTH_BULL, "breadth broad").when(F.col("breadth") <= BREADTH_BEAR, "breadth narrow"),
        F.when(F.col("direction") == 0, "evidence mixed"),
        F.concat(F.lit("family "), "family")))
    return t.withColumns({"label": F.concat_ws("_", word, "family"), "allows_long": F.col("direction") >= 0,
                          "allows_short": F.col("direction") <= 0, "reasons": reasons})


def regime_shares(table: DataFrame, least: float = 0.05) -> DataFrame:
    """Share of sessions per family and whether it reaches the floor."""
    total = F.sum("sessions").over(Window.partitionBy(F.lit(1)))
    return (table.groupBy("family").agg(F.count(F.lit(1)).alias("sessions"))
            .withColumn("share", F.col("sessions") / total).withColumn("reached", F.col("share") >= least))
