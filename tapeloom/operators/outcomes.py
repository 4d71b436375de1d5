"""From signals to fills, sizes, exits and trade results, without account state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.intraday import LONG, SessionTimes, clock, session_window

# Round-trip statutory cost of the two profiles in basis points (documented anchors).
STATUTORY_BPS = {"equity_intraday": 14.6, "equity_delivery": 28.2}


@dataclass(frozen=True)
class CostParams:
    profile: str = "equity_intraday"
    slippage_bps: float = 5.0

    @property
    def round_trip_rate(self) -> float:
        return (STATUTORY_BPS[self.profile] + 2 * self.slippage_bps) / 1e4

    @property
    def side_rate(self) -> float:
        return STATUTORY_BPS[self.profile] / 2e4


@dataclass(frozen=True)
class SizeParams:
    capital: float = 40000.0
    per_trade_risk_pct: float = 0.5
    gross_mult: float = 3.0
    position_pct: float = 30.0
    participation_pct: float = 1.0
    min_notional: float = 5000.0

    @property
    def budget(self) -> float:
        return self.capital * self.per_trade_risk_pct / 100

    @property
    def notional_cap(self) -> float:
        return self.capital * self.gross_mult * self.position_pct / 100


def cost_model(trades: DataFrame, costs: CostParams = CostParams(), price: str = "entry_price", qty: str = "quantity") -> DataFrame:
    """Statutory cost, slippage and the round-trip total of each trade's notional."""
    notional = F.col(price) * F.col(qty)
    return trades.withColumns({"statutory": notional * (2 * costs.side_rate), "slippage": notional * (2 * costs.slippage_bps / 1e4),
                               "round_trip": notional * costs.round_trip_rate})


def next_bar_fill(signals: DataFrame, bars: DataFrame, slippage_bps: float = 5.0) -> DataFrame:
    """Fill at the open of the symbol's next bar of the session with adverse slippage.

    A signal on the last bar never fills; an open through the stop or past the target drops the trade.
    """
    w = session_window()
    nxt = bars.select("symbol", "trade_date", "bar_ts", F.lead("bar_ts").over(w).alias("fill_ts"), F.lead("open").over(w).alias("fill_ref"))
    f = signals.join(nxt, ["symbol", "trade_date", "bar_ts"]).filter(F.col("fill_ts").isNotNull())
    up = (F.col("stop") < F.col("fill_ref")) & (F.col("fill_ref") < F.col("target"))
    down = (F.col("target") < F.col("fill_ref")) & (F.col("fill_ref") < F.col("stop"))
    kept = f.filter(F.when(F.col("side") == LONG, up).otherwise(down))
    slip = F.col("fill_ref") * slippage_bps / 1e4
    return kept.withColumn("fill_price", F.when(F.col("side") == LONG, F.col("fill_ref") + slip).otherwise(F.col("fill_ref") - slip))


def size_columns(orders: DataFrame, p: SizeParams = SizeParams(), cost_rate: float = CostParams().round_trip_rate, entry: str = "entry") -> DataFrame:
    """Quantity from the risk budget including costs, then the stateless caps; the binding cap and why it is refused."""
    price = F.col(entry)
    risk = F.abs(price - F.col("stop"))
    caps = {"risk_budget": F.floor(p.budget / (risk + price * cost_rate)), "position_notional": F.floor(p.notional_cap / price),
            "participation": F.when(F.col("median_volume") > 0, F.floor(F.col("median_volume") * p.participation_pct / 100))}
    least = F.least(*caps.values())
    binding = F.lit(None).cast("string")
    for name, cap in reversed(caps.items()):
        binding = F.when(cap == least, name).otherwise(binding)
    qty = F.greatest(least, F.lit(0))
    reason = (F.when(~(risk > 0), "no stop distance").when(caps["risk_budget"] < 1, "budget").when(qty < 1, "cap allows none")
              .when(qty * price < p.min_notional, "below notional floor").otherwise("ok"))
    return orders.withColumns({"quantity": qty.cast("long"), "binding_cap": binding, "decision": reason, "approved": reason == "ok"})


def first_touch_exit(filled: DataFrame, bars: DataFrame, times: SessionTimes) -> DataFrame:
    """First later bar that touches stop or target (the stop wins inside one bar), else the square-off close.

    A signal meets only the bars of its own session, so the join grows with the bars per session, not the history.
    """
    whole = Window.partitionBy("symbol", "trade_date")
    later = bars.select("symbol", "trade_date", F.col("bar_ts").alias("exit_ts"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("close").alias("_c"),
                        ((clock() >= times.square_off) | (F.col("bar_ts") == F.max("bar_ts").over(whole))).alias("_end"))
    j = filled.join(later, ["symbol", "trade_date"]).filter(F.col("exit_ts") >= F.col("fill_ts"))
    long, after = F.col("side") == LONG, F.col("exit_ts") > F.col("fill_ts")
    stop = after & F.when(long, F.col("_l") <= F.col("stop")).otherwise(F.col("_h") >= F.col("stop"))
    goal = after & F.when(long, F.col("_h") >= F.col("target")).otherwise(F.col("_l") <= F.col("target"))
    ends = (F.when(stop, F.struct("exit_ts", F.lit(0).alias("p"), F.lit("stop").alias("reason"), F.col("stop").alias("price")))
            .when(goal, F.struct("exit_ts", F.lit(1).alias("p"), F.lit("target").alias("reason"), F.col("target").alias("price")))
            .when(F.col("_end"), F.struct("exit_ts", F.lit(2).alias("p"), F.lit("squareoff").alias("reason"), F.col("_c").alias("price"))))
    keys = ["symbol", "trade_date", "bar_ts"]
    first = j.withColumn("_x", ends).groupBy(*keys).agg(F.min("_x").alias("_x"))
    return filled.join(first, keys).select(filled["*"], F.col("_x.exit_ts").alias("exit_ts"), F.col("_x.reason").alias("reason"), F.col("_x.price").alias("exit_ref"))


def excursion(closed: DataFrame, bars: DataFrame) -> DataFrame:
    """Best favourable price from the fill until the exit bar."""
    b = bars.select("symbol", "trade_date", F.col("bar_ts").alias("_t"), "high", "low")
    j = closed.select("symbol", "trade_date", "bar_ts", "side", "fill_ts", "exit_ts", "fill_price").join(b, ["symbol", "trade_date"])
    inside = (F.col("_t") > F.col("fill_ts")) & (F.col("_t") <= F.col("exit_ts"))
    g = j.groupBy("symbol", "trade_date", "bar_ts", "side", "fill_price").agg(
        F.max(F.when(inside, F.col("high"))).alias("_hi"), F.min(F.when(inside, F.col("low"))).alias("_lo"))
    best = F.when(F.col("side") == LONG, F.greatest("fill_price", "_hi")).otherwise(F.least("fill_price", "_lo"))
    return g.select("symbol", "trade_date", "bar_ts", best.alias("best_price"))


def exit_price(slippage_bps: float) -> Column:
    slip = F.col("exit_ref") * slippage_bps / 1e4
    return F.when(F.col("side") == LONG, F.col("exit_ref") - slip).otherwise(F.col("exit_ref") + slip)


def trade_pnl(closed: DataFrame, costs: CostParams = CostParams()) -> DataFrame:
    """Signed gross, costs, net and win flag; needs quantity, fill_price and exit_price."""
    sign = F.when(F.col("side") == LONG, 1.0).otherwise(-1.0)
    gross = sign * (F.col("exit_price") - F.col("fill_price")) * F.col("quantity")
    cost = (F.col("exit_price") + F.col("fill_price")) * F.col("quantity") * costs.side_rate
    return closed.withColumns({"gross_pnl": gross, "costs": cost}).withColumn("net_pnl", F.col("gross_pnl") - F.col("costs")).withColumn(
        "win", F.col("net_pnl") > 0)


def slippage_measure(closed: DataFrame, slippage_bps: float = 5.0) -> DataFrame:
    """Modelled and observed slippage per session: entries against the decision close (signed, not clamped), exits by the model."""
    rate, q = slippage_bps / 1e4, F.col("quantity")
    modelled = (F.abs("fill_ref") + F.abs("exit_ref")) * q * rate
    adverse = F.when(F.col("side") == LONG, F.col("fill_price") - F.col("entry")).otherwise(F.col("entry") - F.col("fill_price"))
    observed = adverse * q + F.abs(F.col("exit_price") - F.col("exit_ref")) * q
    return closed.groupBy("trade_date").agg(
        F.sum(modelled).alias("modelled_slippage"), F.sum(observed).alias("observed_slippage"),
        F.when(F.count(F.lit(1)) > 0, "market").otherwise("modelled").alias("slippage_source"))
