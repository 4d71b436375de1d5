"""Analytics and limits over completed trades and session records.

A session record has one row per trading day, so windows over sessions are bounded by the calendar. Trades inside a
day are not bounded: their running sums use the range-ordered helper.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.frames import beside, ratio
from tapeloom.functions.indicators import drawdown_curve
from tapeloom.operators.statistics import DAYS_PER_YEAR
from tapeloom.plans import ordered

NORMAL_END = "square_off"


def by_session():
    """All sessions in order; one row per trading day, so one window partition is bounded by the calendar."""
    return Window.orderBy("trade_date")


def net_trades(trades: DataFrame) -> DataFrame:
    return trades.withColumn("net_pnl", F.col("gross_pnl") - F.col("costs"))


def breakeven_diagnosis(trades: DataFrame, zero_is_loss: bool = True) -> DataFrame:
    """Payoff against hit rate per strategy and in total (``ALL``); null ratios when one side is empty."""
    loss = F.col("net_pnl") <= 0 if zero_is_loss else F.col("net_pnl") < 0
    g = trades.rollup("strategy").agg(
        F.grouping("strategy").alias("_all"), F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net"), F.sum("costs").alias("costs"),
        F.avg(F.when(F.col("net_pnl") > 0, F.col("net_pnl"))).alias("avg_win"), F.abs(F.avg(F.when(loss, F.col("net_pnl")))).alias("avg_loss"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("actual"))
    payoff = F.when(F.col("avg_loss") > 0, F.col("avg_win") / F.col("avg_loss"))
    out = g.withColumn("strategy", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("strategy"))).withColumn("payoff", payoff)
    return out.withColumn("needed", 1 / (1 + F.col("payoff"))).withColumn("gap", F.col("actual") - F.col("needed")).drop("_all")


def exit_mix(trades: DataFrame) -> DataFrame:
    return trades.groupBy("strategy", "reason").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("net_pnl").alias("mean"), F.sum("net_pnl").alias("net"),
        (100 * F.avg((F.col("net_pnl") > 0).cast("double"))).alias("win_rate_pct"))


def regime_attribution(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("regime").agg(F.count(F.lit(1)).alias("sessions"), F.sum("net_pnl").alias("net"),
                                          F.avg("net_pnl").alias("mean"), F.sum("trades").alias("trades"))


def cost_drag(trades: DataFrame) -> DataFrame:
    notional = F.avg(F.col("quantity") * F.col("entry_price"))
    return trades.agg(F.avg("costs").alias("mean_cost"), notional.alias("mean_notional"),
                      (ratio(F.avg("costs"), notional) * 1e4).alias("cost_bps"),
                      (F.sum("costs") / F.nullif(F.sum(F.abs("gross_pnl")), F.lit(0.0))).alias("cost_share"))


def halt_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per halt kind, normal session ends left out, and their share of all sessions."""
    total = sessions.select(F.count(F.lit(1)))
    kinds = sessions.filter(F.col("halt_kind").isNotNull() & (F.col("halt_kind") != "") & (F.col("halt_kind") != NORMAL_END))
    return kinds.groupBy("halt_kind").agg(F.count(F.lit(1)).alias("sessions")).withColumn("share", F.col("sessions") / total.scalar())


def session_record(trades: DataFrame, signals: DataFrame, context: DataFrame, halts: DataFrame, loss_limit: float,
                   slippage: DataFrame | None = None, fill_source: str = "simulated") -> DataFrame:
    """One 19-column row per session from trades and signal rows.

    ``signals``: trade_date, outcome (entered / rejected); ``context``: trade_date, regime, universe_size;
    ``halts``: trade_date, halt_kind, halt_reason; ``slippage``: modelled and observed per session.
    """
    t = trades.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("net_pnl") > 0).alias("wins"), F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("costs").alias("costs"), F.sum("net_pnl").alias("net_pnl"))
    s = signals.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(F.col("outcome") == "entered").alias("entries"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_by_risk"))
    out = context.join(t, "trade_date", "left").join(s, "trade_date", "left").join(halts, "trade_date", "left")
    if slippage is None:
        out = out.withColumns({"modelled_slippage": F.lit(0.0), "observed_slippage": F.lit(0.0), "slippage_source": F.lit("modelled")})
    else:
        out = out.join(slippage, "trade_date", "left")
    zero = ["trades", "wins", "gross_pnl", "costs", "net_pnl", "signals", "entries", "rejected_by_risk", "modelled_slippage", "observed_slippage"]
    return out.na.fill(0, zero).select(
        "trade_date", "regime", "universe_size", "trades", "wins", "gross_pnl", "costs", "net_pnl", "signals", "entries", "rejected_by_risk",
        (F.col("halt_kind").isNotNull() & (F.col("halt_kind") != NORMAL_END)).alias("halted"), "halt_reason", "halt_kind", "modelled_slippage", "observed_slippage",
        F.lit(fill_source).alias("fill_source"), F.coalesce("slippage_source", F.lit("modelled")).alias("slippage_source"), F.lit(loss_limit).alias("loss_limit"))


def profit_factor(col: str = "net_pnl") -> Column:
    """Gains ÷ losses; infinite without losses becomes null."""
    return F.sum(F.greatest(F.col(col), F.lit(0.0))) / F.nullif(F.abs(F.sum(F.least(F.col(col), F.lit(0.0)))), F.lit(0.0))


def replay_summary(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("trades").alias("trades"), (F.sum("wins") / F.nullif(F.sum("trades"), F.lit(0))).alias("win_rate"),
        F.sum("gross_pnl").alias("gross"), F.sum("costs").alias("costs"), F.sum("net_pnl").alias("net"), F.max("net_pnl").alias("best"),
        F.min("net_pnl").alias("worst"), profit_factor().alias("profit_factor"), F.count_if(F.col("net_pnl") < -F.col("loss_limit")).alias("breaches"),
        F.count_if("halted").alias("halted"))


@dataclass(frozen=True)
class EvidenceCriteria:
    min_sessions: int = 20
    min_trades: int = 40
    min_net: float = 0.0
    min_profit_factor: float = 1.2
    max_slippage_ratio: float = 1.5
    max_age_days: int = 14


def evidence_scorecard(sessions: DataFrame, now: str, c: EvidenceCriteria = EvidenceCriteria()) -> DataFrame:
    """Named checks over a session record, one row each, from a single aggregate."""
    measured = F.lower("slippage_source").isin("market", "broker")
    a = sessions.agg(
        F.count(F.lit(1)).alias("n"), F.sum("trades").alias("tr"), F.sum("net_pnl").alias("net"), profit_factor().alias("pf"),
        F.sum(F.greatest("net_pnl", F.lit(0.0))).alias("gain"), F.count_if(measured).alias("real"), F.sum("observed_slippage").alias("obs"),
        F.sum("modelled_slippage").alias("mod"), F.count_if(F.col("net_pnl") < -F.col("loss_limit")).alias("breach"), F.max("trade_date").alias("last"))
    pf_ok = F.when(F.col("pf").isNull(), F.col("gain") > 0).otherwise(F.col("pf") >= c.min_profit_factor)
    ratio = F.when(F.col("mod") > 0, F.col("obs") / F.col("mod"))
    age = F.datediff(F.lit(now).cast("date"), F.col("last"))
    checks = [("sessions", F.col("n") >= c.min_sessions, F.col("n")), ("trades", F.col("tr") >= c.min_trades, F.col("tr")),
              ("net_profitability", F.col("net") > c.min_net, F.col("net")), ("profit_factor", pf_ok, F.col("pf")),
              ("slippage_fidelity", (F.col("real") > 0) & (ratio <= c.max_slippage_ratio), ratio),
              ("daily_limit_respected", F.col("breach") == 0, F.col("breach")), ("freshness", age <= c.max_age_days, age)]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), v.cast("double").alias("value")) for n, ok, v in checks])
    return a.select(F.explode(rows).alias("c")).select("c.*")


# Checks a person may waive.
WAIVABLE = ("net_profitability", "profit_factor", "sessions", "trades")


def waiver_apply(checks: DataFrame, waivers: DataFrame, allowed: Sequence[str] = WAIVABLE) -> DataFrame:
    """PASS / WAIVED / FAIL / REFUSED; a waiver needs an allowed check and a reason and is moot on a passed one."""
    asked = waivers.groupBy("check").agg(F.max("waiver_reason").alias("waiver_reason"))
    reason = F.nullif(F.trim("waiver_reason"), F.lit(""))
    status = (F.when(F.col("ok"), "PASS").when(F.col("_asked").isNull(), "FAIL")
              .when(~F.col("check").isin(list(allowed)) | reason.isNull(), "REFUSED").otherwise("WAIVED"))
    j = checks.join(asked.withColumn("_asked", F.lit(1)), "check", "left")
    return j.withColumn("status", status).drop("_asked")


def peak_drawdown_limit(sessions: DataFrame, capital: float, limit_pct: float) -> DataFrame:
    """Cumulative net, its peak (never below zero), drawdown, trip flag, room and sessions left at the mean rate."""
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    limit = capital * limit_pct / 100
    s = sessions.withColumn("equity", F.sum("net_pnl").over(upto))
    s = s.withColumns({"peak": F.greatest(F.max("equity").over(upto), F.lit(0.0)), "rate": F.avg("net_pnl").over(upto)})
    s = s.withColumn("drawdown", F.col("peak") - F.col("equity")).withColumn("tripped", F.col("drawdown") >= limit)
    room = F.when(~F.col("tripped"), limit - F.col("drawdown"))
    left = F.when(F.col("rate") < 0, F.floor(room / F.abs("rate")))
    return s.select("trade_date", "equity", "peak", "drawdown", "tripped", room.alias("room"), left.alias("sessions_left"))


@dataclass(frozen=True)
class LimitParams:
    loss_limit: float = 800.0
    profit_lock: float = 1200.0
    max_losses: int = 4
    max_trades: int = 12


def session_limit_audit(trades: DataFrame, p: LimitParams = LimitParams()) -> DataFrame:
    """Per session, trades ordered by close: first halt and its kind, longest losing streak, trades beyond the cap,
    trades opened after the halt. Streaks are islands between running counts of non-losing trades."""
    order = [F.col("close_min"), F.col("trade_id")]
    won = (F.col("net_pnl") >= 0).cast("long")
    run = ordered.running_sums(trades.select("trade_date", "trade_id", "open_min", "close_min", "net_pnl"), ["trade_date"], order,
                               {"running_net": F.col("net_pnl"), "island": won, "losses": 1 - won})
    islands = run.groupBy("trade_date", "island").agg(F.min("losses").alias("_lo"), F.max("losses").alias("_hi"))
    islands = islands.withColumn("_base", F.when(F.col("island") == 0, 0).otherwise(F.col("_lo")))
    streak = F.col("losses") - F.col("_base")
    hit = (F.when(F.col("running_net") <= -p.loss_limit, "loss_limit").when(F.col("running_net") >= p.profit_lock, "profit_lock")
           .when((streak >= p.max_losses), "consecutive_losses"))
    marked = run.join(islands, ["trade_date", "island"]).withColumn("_kind", hit)
    per = marked.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("trades"), F.max(F.col("_hi") - F.col("_base")).alias("longest_losing_streak"),
        F.min(F.when(F.col("_kind").isNotNull(), F.struct("close_min", "trade_id", F.col("_kind").alias("kind")))).alias("_h"))
    halts = per.select("trade_date", "trades", "longest_losing_streak", F.greatest(F.col("trades") - p.max_trades, F.lit(0)).alias("beyond_cap"),
                       F.col("_h.close_min").alias("halt_min"), F.col("_h.kind").alias("halt_kind"))
    stopped = F.broadcast(halts.filter("halt_min IS NOT NULL").select("trade_date", "halt_min"))  # one row per session
    after = (trades.join(stopped, "trade_date")
             .filter(F.col("open_min") > F.col("halt_min")).groupBy("trade_date").agg(F.count(F.lit(1)).alias("opened_after_halt")))
    return halts.join(after, "trade_date", "left").na.fill(0, ["opened_after_halt"])


def open_exposure(trades: DataFrame, risk: Column | None = None) -> DataFrame:
    """Open positions, gross exposure and worst-case risk at each event minute of a session.

    Openings and closings are netted per minute first, so a session has at most 1,440 rows in its window.
    """
    notional = F.col("quantity") * F.col("entry_price")
    worst = notional * 0.01 if risk is None else risk
    ev = trades.select("trade_date", notional.alias("_n"), worst.alias("_r"), F.explode(F.array(
        F.struct(F.col("open_min").alias("minute"), F.lit(1).alias("d")), F.struct(F.col("close_min").alias("minute"), F.lit(-1).alias("d")))).alias("e"))
    d = F.col("e.d")
    net = ev.groupBy("trade_date", F.col("e.minute").alias("minute")).agg(F.sum(d).alias("_p"), F.sum(d * F.col("_n")).alias("_g"), F.sum(d * F.col("_r")).alias("_w"))
    w = Window.partitionBy("trade_date").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return net.select("trade_date", "minute", F.sum("_p").over(w).alias("open_positions"), F.sum("_g").over(w).alias("gross_exposure"), F.sum("_w").over(w).alias("open_risk"))


def session_vs_prior(sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each calendar day's session against the mean of earlier ones; days without a session say so."""
    prior = by_session().rowsBetween(Window.unboundedPreceding, -1)
    s = sessions.select("trade_date", "net_pnl", F.avg("net_pnl").over(prior).alias("prior_mean"), F.count("net_pnl").over(prior).alias("prior_sessions"),
                        (F.col("net_pnl") < -F.col("loss_limit")).alias("breached"))
    j = calendar.join(s, "trade_date", "left")
    return j.withColumn("status", F.when(F.col("net_pnl").isNull(), "none").when(F.col("breached"), "breached").otherwise("held")).drop("breached")


def equity_curve(sessions: DataFrame, capital: float) -> DataFrame:
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    return sessions.select("trade_date", (capital + F.sum("net_pnl").over(upto)).alias("equity"))


def yearly_trades(trades: DataFrame, equity: DataFrame) -> DataFrame:
    y = trades.groupBy(F.year("trade_date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("gross_pnl").alias("gross"), F.sum("costs").alias("costs"), F.sum("net_pnl").alias("net"),
        (100 * F.avg((F.col("net_pnl") > 0).cast("double"))).alias("win_rate_pct"))
    e = equity.groupBy(F.year("trade_date").cast("long").alias("year")).agg(F.max_by("equity", "trade_date").alias("equity_end"))
    return y.join(e, "year", "left")


def swing_summary(trades: DataFrame, equity: DataFrame, capital: float, benchmark_pct: Column | float, per_year: int = 252) -> DataFrame:
    """Return, risk and trade quality of one run, and the difference to a benchmark return in percentage points.

    Sharpe: mean ÷ sample deviation of session returns, annualised. Top-trade share: best net ÷ all winning net.
    Exposure: sessions with trades ÷ weekdays of the span.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("trade_date")
    curve = drawdown_curve(equity.withColumn("_one", F.lit(1)), "equity", ["_one"], "trade_date").withColumn("_r", ratio(F.col("equity"), F.lag("equity").over(w)) - 1)
    c = curve.agg(F.max_by("equity", "trade_date").alias("final_equity"), (F.datediff(F.max("trade_date"), F.min("trade_date")) / DAYS_PER_YEAR).alias("years"),
                  F.min("trade_date").alias("_d0"), F.max("trade_date").alias("_d1"), F.count(F.lit(1)).alias("sessions"),
                  (100 * F.min("drawdown")).alias("max_drawdown_pct"), (ratio(F.avg("_r"), F.stddev_samp("_r")) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"))
    t = trades.agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net"), (100 * F.avg((F.col("net_pnl") > 0).cast("double"))).alias("win_rate_pct"),
                   profit_factor().alias("profit_factor"), F.avg((F.col("close_min") - F.col("open_min")) / 1440).alias("avg_hold_days"),
                   ratio(F.max("net_pnl"), F.sum(F.greatest("net_pnl", F.lit(0.0)))).alias("top_trade_share"))
    days = F.size(F.filter(F.sequence("_d0", "_d1"), lambda d: F.weekday(d) < 5))
    ret = 100 * (F.col("final_equity") / capital - 1)
    growth = F.when(F.col("final_equity") > 0, 100 * (F.pow(F.col("final_equity") / capital, 1 / F.col("years")) - 1))
    return beside(c, t).select("sessions", "trades", "net", "final_equity", ret.alias("return_pct"), growth.alias("cagr_pct"), "max_drawdown_pct", "sharpe", "win_rate_pct",
                                 "profit_factor", "avg_hold_days", "top_trade_share", (100 * F.col("sessions") / days).alias("exposure_pct"), (ret - benchmark_pct).alias("vs_benchmark_pp"))


def record_fingerprint(record: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order-insensitive digest and description: xor and sum of row hashes (the sum keeps equal rows from cancelling)."""
    h = F.xxhash64(*cols)
    return record.agg(F.bit_xor(h).alias("digest_xor"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("digest_sum"), F.count(F.lit(1)).alias("rows"),
                      F.sum("trades").alias("trades"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.sum("net_pnl").alias("net"))


def record_drift(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Fields of a description that differ from the stored one; both are single rows."""
    fields = now.columns
    pair = beside(now.select(F.struct(*fields).alias("a")), stored.select(F.struct(*fields).alias("b")))
    diffs = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    return pair.select(F.array_join(diffs, ",").alias("drifted"), (F.size(diffs) == 0).alias("matches"))


def generated_vs_stored(generated: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows missing from and unexpected in the stored table (multiset difference both ways)."""
    stored = stored.select(*generated.columns)
    missing = generated.exceptAll(stored).agg(F.count(F.lit(1)).alias("missing"))
    extra = stored.exceptAll(generated).agg(F.count(F.lit(1)).alias("unexpected"))
    return beside(missing, extra).withColumn("differs", (F.col("missing") + F.col("unexpected")) > 0)
