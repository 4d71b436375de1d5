"""Statistics of rankings and return series.

A return series has one row per session, so the windows below are bounded by the calendar. Several series (grid
cells, halves, random trials) carry a key and are processed side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.frames import beside, finite, lookback, ratio
from tapeloom.functions.indicators import drawdown_curve
from tapeloom.operators import xsection as xs
from tapeloom.operators.calendars import align_calendar, mark_ffill
from tapeloom.plans import ordered
from tapeloom.session import settle

PER_YEAR = 252
DAYS_PER_YEAR = 365.25
MIN_YEARS_FOR_VERDICT = 15.0


@dataclass(frozen=True)
class SpreadParams:
    n_side: int = 100
    step: int = 21
    look: int = 252
    skip: int = 21


def with_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", ratio(F.col("close"), lookback("close", 1)) - 1)


def _formations(scored: DataFrame, p: SpreadParams, start: int = 0) -> DataFrame:
    """Eligible scored rows of the formation sessions: row look+1 (counted from ``start``) and every step after."""
    off = F.col("session_no") - start - p.look - 2
    rows = scored.filter(F.col("eligible") & F.col("score").isNotNull())
    return rows.filter((off >= 0) & (F.pmod(off, F.lit(p.step)) == 0))


def baskets(scored: DataFrame, p: SpreadParams, start: int = 0) -> DataFrame:
    """Long and short names of every formation with at least 4·n_side eligible names.

    Ties: the smaller key is short first, the larger key is long first. Both tails are limited per task before the
    shuffle; only the per-date counts and 2·n_side rows per date go on.
    """
    rows = _formations(scored, p, start).select("session_no", "symbol", "score")
    wide = rows.groupBy("session_no").agg(F.count(F.lit(1)).alias("width")).filter(F.col("width") >= 4 * p.n_side)
    long = xs.top_n(rows, p.n_side, ["session_no"], [F.col("score").desc(), F.col("symbol").desc()])
    short = xs.top_n(rows, p.n_side, ["session_no"], [F.col("score").asc(), F.col("symbol").asc()])
    both = long.withColumn("side", F.lit(1)).unionByName(short.withColumn("side", F.lit(-1)))
    return both.join(F.broadcast(wide.select("session_no")), "session_no").select(
        F.col("session_no").alias("formed"), "symbol", "side")


def decile_spread(scored: DataFrame, p: SpreadParams = SpreadParams(), start: int = 0, end: int | None = None) -> DataFrame:
    """Daily mean(long) − mean(short) of baskets held from their formation row until the next one.

    ``start``/``end`` restrict to a contiguous part of the calendar whose rows are numbered afresh; the first row of
    a part has no return.
    """
    part = settle(scored, "symbol", "date", "session_no", "close", "eligible", "score").filter(F.col("session_no") > start)
    if end is not None:
        part = part.filter(F.col("session_no") <= end)
    rets = with_returns(part).filter(F.col("ret").isNotNull()).select("symbol", "session_no", "date", "ret")
    held = baskets(part, p, start).withColumn(
        "session_no", F.explode(F.sequence(F.col("formed"), F.col("formed") + p.step - 1)))
    daily = held.join(rets, ["symbol", "session_no"]).groupBy("session_no", "date", "formed").agg(
        F.avg(F.when(F.col("side") == 1, F.col("ret"))).alias("long_ret"), F.count_if(F.col("side") == 1).alias("longs"),
        F.avg(F.when(F.col("side") == -1, F.col("ret"))).alias("short_ret"), F.count_if(F.col("side") == -1).alias("shorts"))
    enough = (F.col("longs") >= p.n_side // 2) & (F.col("shorts") >= p.n_side // 2) & (F.col("longs") > 0) & (F.col("shorts") > 0)
    return daily.filter(enough).withColumn("spread", F.col("long_ret") - F.col("short_ret"))


def newey_west(series: DataFrame, value: str, lags: int, keys: Sequence[str] = (), order: str = "session_no") -> DataFrame:
    """Mean, Bartlett-kernel standard error of the mean and t per series; null when n < lags + 5."""
    part = list(keys) or [F.lit(1)]
    x = series.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("x"))
    centred = x.withColumn("_e", F.col("x") - F.avg("x").over(Window.partitionBy(*part)))
    w = Window.partitionBy(*part).orderBy(order)
    lagged = centred.select(*keys, "x", "_e", *[F.lag("_e", k).over(w).alias(f"_e{k}") for k in range(1, lags + 1)])
    total = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        weight = 2.0 * (1.0 - k / (lags + 1.0))
        total = total + weight * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0))
    agg = lagged.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), total.alias("_s"))
    se = F.sqrt(F.greatest(F.col("_s") / F.col("n"), F.lit(0.0)) / F.col("n"))
    ok = F.col("n") >= lags + 5
    return agg.select(*keys, "n", F.when(ok, F.col("mean")).alias("mean"), F.when(ok, se).alias("se"),
                      F.when(ok & (se > 0), F.col("mean") / se).alias("t"))


def spread_summary(daily: DataFrame, lags: int, keys: Sequence[str] = (), per_year: int = PER_YEAR) -> DataFrame:
    nw = newey_west(daily, "spread", lags, keys)
    span = daily.groupBy(*keys).agg((F.datediff(F.max("date"), F.min("date")) / DAYS_PER_YEAR).alias("years"),
                                    F.countDistinct("formed").alias("rebalances"))
    one = nw.join(span, list(keys)) if keys else beside(nw, span)
    annual, half = per_year * 100.0 * F.col("mean"), 1.96 * per_year * 100.0 * F.col("se")
    return one.withColumns({"annual_pct": annual, "ci_low": annual - half, "ci_high": annual + half})


def fama_macbeth_slopes(scored: DataFrame, p: SpreadParams = SpreadParams(), min_names: int = 50,
                        last_session: Column | None = None) -> DataFrame:
    """Per formation: slope of the forward ``step`` return on the rank scaled to [0, 1], and the width.

    The last usable formation leaves ``step`` sessions of calendar after it.
    """
    ahead = scored.withColumn("_fwd", ratio(lookback("close", -p.step), F.col("close")) - 1)
    rows = _formations(ahead, p).filter(F.col("_fwd").isNotNull()).select("session_no", "date", "symbol", "score", "_fwd")
    ranked = ordered.row_numbers(rows, ["session_no"], [F.col("score").asc(), F.col("symbol").asc()])
    x = (F.col("rank") - 1) / F.greatest(F.col("size") - 1, F.lit(1))
    per = ranked.groupBy("session_no", "date").agg(F.regr_slope("_fwd", x).alias("slope"), F.count(F.lit(1)).alias("width"))
    return per.filter((F.col("width") >= min_names) & F.col("slope").isNotNull())


def fama_macbeth(slopes: DataFrame, lags: int = 3) -> DataFrame:
    return beside(newey_west(slopes, "slope", lags), slopes.agg(F.count(F.lit(1)).alias("periods"), F.avg("width").alias("avg_names")))


def stage1_verdict(scored: DataFrame, p: SpreadParams, lags: int, sessions: int, min_names: int = 50,
                   per_year: int = PER_YEAR) -> DataFrame:
    """Spread over the whole span and both halves, Fama-MacBeth, and the pre-registered verdict.

    ``scored`` is read by six branches, so it is settled once. The halves re-warm from their own first row; the
    eligibility mask is the full panel's.
    """
    base = settle(scored, "symbol", "date", "session_no", "close", "eligible", "score")
    half = sessions // 2
    runs = [("full", decile_spread(base, p))]
    if half > p.look + 2 * p.step:
        runs += [("first", decile_spread(base, p, 0, half)), ("second", decile_spread(base, p, half))]
    daily = runs[0][1].withColumn("part", F.lit("full"))
    for name, df in runs[1:]:
        daily = daily.unionByName(df.withColumn("part", F.lit(name)))
    s = spread_summary(daily, lags, ["part"], per_year)

    def pick(part: str, col: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(col)))
    one = s.agg(pick("full", "mean").alias("mean"), pick("full", "t").alias("t"), pick("full", "years").alias("years"),
                pick("full", "annual_pct").alias("annual_pct"), pick("first", "mean").alias("first_mean"),
                pick("second", "mean").alias("second_mean"))
    fm = fama_macbeth(fama_macbeth_slopes(base, p, min_names)).select(
        F.col("mean").alias("fm_mean"), F.col("t").alias("fm_t"), "periods", "avg_names")
    bad_half = F.col("first_mean").isNotNull() & F.col("second_mean").isNotNull() & ~(
        (F.col("first_mean") > 0) & (F.col("second_mean") > 0))
    verdict = (F.when(F.col("t").isNull(), "INCONCLUSIVE").when((F.col("t") <= -2) | (F.col("mean") < 0), "FAIL")
               .when(F.col("t") < 2, "INCONCLUSIVE").when(bad_half, "INCONCLUSIVE").otherwise("PASS"))
    return beside(one, fm).withColumns({"verdict": verdict, "pilot": F.col("years") < MIN_YEARS_FOR_VERDICT})


def series_align(a: DataFrame, b: DataFrame, order: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Returns of two value series on their common dates; own-row after the alignment."""
    both = (a.filter(F.col("value").isNotNull()).select(*keys, order, F.col("value").alias("_a"))
            .join(b.filter(F.col("value").isNotNull()).select(*keys, order, F.col("value").alias("_b")), [*keys, order]))
    w = Window.partitionBy(*(list(keys) or [F.lit(1)])).orderBy(order)
    r = both.select(*keys, order, (ratio(F.col("_a"), F.lag("_a").over(w)) - 1).alias("rs"), (ratio(F.col("_b"), F.lag("_b").over(w)) - 1).alias("rb"))
    return r.filter(F.col("rs").isNotNull() & F.col("rb").isNotNull())


def alpha_beta(aligned: DataFrame, keys: Sequence[str] = (), per_year: int = PER_YEAR, least: int = 30) -> DataFrame:
    """OLS of strategy on benchmark returns with plain standard errors; series shorter than ``least`` give nulls."""
    a = aligned.groupBy(*keys).agg(
        F.regr_slope("rs", "rb").alias("beta"), F.regr_intercept("rs", "rb").alias("_alpha"), F.corr("rs", "rb").alias("correlation"),
        F.regr_syy("rs", "rb").alias("_syy"), F.regr_sxx("rs", "rb").alias("_sxx"), F.regr_sxy("rs", "rb").alias("_sxy"),
        F.count(F.lit(1)).alias("observations"))
    n = F.col("observations")
    resid = F.greatest(F.col("_syy") - F.col("beta") * F.col("_sxy"), F.lit(0.0))
    s = F.sqrt(resid / (n - 2))
    se_a = s / F.sqrt(n)
    se_b = s / (F.sqrt(F.col("_sxx") / (n - 1)) * F.sqrt(n))
    ok = n >= least
    return a.select(*keys, "observations", F.when(ok, F.col("beta")).alias("beta"),
                    F.when(ok, per_year * 100.0 * F.col("_alpha")).alias("alpha_annual_pct"),
                    F.when(ok & (se_a > 0), F.col("_alpha") / se_a).alias("t_alpha"),
                    F.when(ok & (se_b > 0), (F.col("beta") - 1) / se_b).alias("t_beta_vs_one"),
                    F.when(ok, F.col("correlation")).alias("correlation"))


def draw_number(*parts: Column) -> Column:
    """A reproducible number from 0 to 2^32 - 1 for whole-number keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def random_targets(scored: DataFrame, n: int, step: int, trials: int) -> DataFrame:
    """trial, rebalance_no, session_no, symbol of ``n`` eligible names drawn at random for every trial and rebalance.

    The eligible names of a session are numbered once; a draw picks places, so there are about 4·n·trials rows per
    session, however many names it has. Of 4·n drawn places (all of them, in random order, when there are no more) the
    first ``n`` different ones count.
    """
    rows = scored.filter(F.col("eligible") & finite(F.col("score"))).join(F.broadcast(xs.rebalance_dates(scored, step).select("session_no", "rebalance_no")), "session_no")
    placed = settle(ordered.row_numbers(rows.select("rebalance_no", "session_no", "symbol"), ["session_no"], [F.col("symbol").asc()], "place", "size"))
    sizes = placed.groupBy("rebalance_no", "session_no").agg(F.max("size").alias("size"))
    tries = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), (F.least("size", F.lit(4 * n)) - 1).cast("int"))))
    drawn, few = draw_number(F.col("trial"), F.col("session_no"), F.col("_k")), F.col("size") <= 4 * n
    places = (tries.select("trial", "rebalance_no", "session_no", (F.when(few, F.col("_k")).otherwise(drawn % F.col("size")) + 1).alias("place"),
                           F.when(few, drawn).otherwise(F.col("_k")).alias("_o"))
              .groupBy("trial", "rebalance_no", "session_no", "place").agg(F.min("_o").alias("_o")))
    picked = xs.top_n(places, n, ["trial", "session_no"], [F.col("_o").asc(), F.col("place").asc()])
    return picked.select("trial", "session_no", "place", "rebalance_no").join(placed.select("session_no", "place", "symbol"), ["session_no", "place"]).select("trial", "rebalance_no", "session_no", "symbol")


def total_returns(scored: DataFrame, targets: DataFrame, n: int, step: int, cost_bps: float = 0.0) -> DataFrame:
    """Total return in per cent of each trial's targets (trial, rebalance_no, session_no, symbol)."""
    days = xs.holdings_days(targets, xs.rebalance_dates(scored, step), scored, n, step, cost_bps, ["trial"])
    return days.groupBy("trial").agg((100 * (F.exp(F.sum(F.log1p("net"))) - 1)).alias("total_pct"))


def random_null(scored: DataFrame, n: int, step: int, trials: int, cost_bps: float = 0.0) -> DataFrame:
    """Total return per trial of random selections: same eligibility, rebalances, costs and engine as the strategy."""
    scored = settle(scored, "symbol", "date", "session_no", "close", "score", "eligible")
    return total_returns(scored, random_targets(scored, n, step, trials), n, step, cost_bps)


def strategy_return(scored: DataFrame, n: int, step: int, cost_bps: float = 0.0) -> DataFrame:
    """The same evaluation of the strategy's own targets, as trial 0."""
    scored = settle(scored, "symbol", "date", "session_no", "close", "score", "eligible")
    return total_returns(scored, xs.targets(scored, n, step).withColumn("trial", F.lit(0)), n, step, cost_bps)


def percentile_of(sample: DataFrame, col: str, value: Column) -> DataFrame:
    """Share (0..100) of the sample strictly below ``value``; what differs in the order of additions only is equal."""
    return sample.agg((100.0 * F.avg((F.round(col, 9) < F.round(value, 9)).cast("double"))).alias("percentile"))


def null_quantiles(sample: DataFrame, col: str, probs: Sequence[float] = (0.05, 0.25, 0.50, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles of a trial distribution; one value per trial."""
    return sample.agg(*[F.percentile(col, p).alias(f"p{round(100 * p)}") for p in probs])


def equal_weight_curve(panel: DataFrame, eligible_only: bool = False) -> DataFrame:
    """Daily-rebalanced equal weight of session-exact returns, compounded."""
    rows = with_returns(panel)
    ret = F.avg(F.when(F.col("eligible"), F.col("ret"))) if eligible_only else F.avg("ret")
    return xs.compound(rows.groupBy("session_no", "date").agg(ret.alias("ret")), "ret", "value")


def buy_and_hold(prices: DataFrame, capital: float, entry_drag: float, exit_drag: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bought at the first close, sold at the last, a cost fraction on both legs."""
    whole = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    curve = capital * (1 - entry_drag) * ratio(F.col("close"), F.first("close").over(whole))
    last = F.col("date") == F.last("date").over(whole)
    return prices.filter(F.col("close").isNotNull()).select(
        *keys, "date", F.when(last, curve * (1 - exit_drag)).otherwise(curve).alias("value"))


def equal_weight_hold(aligned: DataFrame, capital: float, entry_drag: float, exit_drag: float) -> DataFrame:
    """Names priced on the first session, normalised, forward-filled and averaged."""
    first = aligned.filter((F.col("session_no") == 1) & (F.col("close") > 0)).select("symbol", F.col("close").alias("_p0"))
    fill = Window.partitionBy("symbol").orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    norm = aligned.join(first, "symbol").withColumn("_v", F.last(F.col("close") / F.col("_p0"), ignorenulls=True).over(fill))
    basket = norm.groupBy("session_no", "date").agg(F.avg("_v").alias("_b"), F.count("_v").alias("names"))
    end = aligned.select(F.max("session_no"))
    curve = capital * (1 - entry_drag) * F.col("_b")
    return basket.select("session_no", "date", "names",
                         F.when(F.col("session_no") == end.scalar(), curve * (1 - exit_drag)).otherwise(curve).alias("value"))


def benchmark_reindex(dates: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark values on the strategy's dates, last known value carried forward."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return dates.join(bench.select("date", "value"), "date", "left").withColumn("value", F.last("value", ignorenulls=True).over(w))


def beta_matched(bench: DataFrame, beta: Column) -> DataFrame:
    """Benchmark returns levered to a beta and compounded."""
    w = Window.orderBy("session_no")
    r = F.coalesce(ratio(F.col("value"), F.lag("value").over(w)) - 1, F.lit(0.0))
    return xs.compound(bench.withColumn("ret", beta * r), "ret", "value").select("session_no", "date", "value")


def leg_stats(curves: DataFrame, keys: Sequence[str] = ("series_id",), per_year: int = PER_YEAR) -> DataFrame:
    """Total, CAGR, Sharpe (mean ÷ sd of simple returns, annualised), worst drawdown and final value per curve."""
    w = Window.partitionBy(*keys).orderBy("date")
    r = drawdown_curve(curves.filter(F.col("value").isNotNull()), "value", keys, "date").withColumn("_r", ratio(F.col("value"), F.lag("value").over(w)) - 1)
    a = r.groupBy(*keys).agg(
        F.min_by("value", "date").alias("_v0"), F.max_by("value", "date").alias("final_value"),
        (F.datediff(F.max("date"), F.min("date")) / DAYS_PER_YEAR).alias("_y"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
        (100 * F.min("drawdown")).alias("max_drawdown_pct"))
    years = F.greatest("_y", F.lit(1e-9))
    total = ratio(F.col("final_value"), F.col("_v0")) - 1
    return a.select(*keys, (100 * total).alias("total_pct"), (100 * (F.pow(1 + total, 1 / years) - 1)).alias("cagr_pct"),
                    F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(per_year)))).alias("sharpe"),
                    "max_drawdown_pct", "final_value")


def sharpe_bar(stats: DataFrame, strategy: str, bench: str) -> DataFrame:
    def pick(name: str) -> Column:
        return F.max(F.when(F.col("series_id") == name, F.col("sharpe")))
    one = stats.agg(pick(strategy).alias("strategy_sharpe"), pick(bench).alias("benchmark_sharpe"))
    ok = F.coalesce(F.col("strategy_sharpe") > F.col("benchmark_sharpe"), F.lit(False))
    return one.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def power_table(scored: DataFrame, sides: Sequence[int], per_year: int = PER_YEAR) -> DataFrame:
    """Volatility of the n×n next-session spread and what it can resolve; the mean is never output."""
    most = max(sides)
    nxt = scored.withColumn("_next", ratio(lookback("close", -1), F.col("close")) - 1)
    rows = settle(nxt.filter(F.col("eligible") & F.col("score").isNotNull()).select("session_no", "symbol", "score", "_next"))
    wide = rows.groupBy("session_no").agg(F.count(F.lit(1)).alias("width"))
    top = xs.top_n(rows, most, ["session_no"], [F.col("score").desc(), F.col("symbol").asc()]).withColumn("side", F.lit(1))
    low = xs.top_n(rows, most, ["session_no"], [F.col("score").asc(), F.col("symbol").asc()]).withColumn("side", F.lit(-1))
    tails = top.unionByName(low).withColumn("n_side", F.explode(F.array(*[F.lit(n) for n in sides]))).filter(F.col("rank") <= F.col("n_side"))
    wider = tails.join(F.broadcast(wide), "session_no").filter(F.col("width") >= 4 * F.col("n_side"))
    up, dn = F.when(F.col("side") == 1, F.col("_next")), F.when(F.col("side") == -1, F.col("_next"))
    daily = wider.groupBy("n_side", "session_no").agg((F.avg(up) - F.avg(dn)).alias("_s"), F.count(up).alias("_l"), F.count(dn).alias("_h"), F.max("width").alias("width"))
    need = F.floor(F.col("n_side") / 2)
    ok = daily.filter((F.col("_l") >= need) & (F.col("_h") >= need) & F.col("_s").isNotNull())
    a = ok.groupBy("n_side").agg(F.count(F.lit(1)).alias("observations"), F.stddev_samp("_s").alias("_sd"), F.avg("width").alias("avg_names"))
    vol = F.col("_sd") * F.sqrt(F.lit(float(per_year))) * 100
    years = F.col("observations") / per_year
    return a.select("n_side", "observations", "avg_names", vol.alias("vol_pct"), (vol / F.sqrt(years)).alias("se_pct"),
                    (2 * vol / F.sqrt(years)).alias("detectable_pct"), F.pow(vol / 2.5, 2).alias("years_for_5pct"))


def yearly_returns(curves: DataFrame) -> DataFrame:
    """Calendar-year first→last % of strategy and benchmark; years with fewer than two rows are left out."""
    a = curves.filter(F.col("strategy").isNotNull()).groupBy(F.year("date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("_n"), F.count("benchmark").alias("_m"),
        (100 * (F.max_by("strategy", "date") / F.min_by("strategy", "date") - 1)).alias("strategy_pct"),
        (100 * (F.max_by("benchmark", F.when(F.col("benchmark").isNotNull(), F.col("date")))
                / F.min_by("benchmark", F.when(F.col("benchmark").isNotNull(), F.col("date"))) - 1)).alias("benchmark_pct"))
    return (a.filter((F.col("_n") >= 2) & (F.col("_m") >= 2))
            .select("year", "strategy_pct", "benchmark_pct", (F.col("strategy_pct") - F.col("benchmark_pct")).alias("excess_pp")))


def breadth(bars: DataFrame, length: int = 50) -> DataFrame:
    """Share of names above the mean of their own last ``length`` bars as of each session.

    A name that did not print counts with its latest bar. Only changes of a name's state are added up, so no grid of
    names and sessions is built; the running sums have one row per session.
    """
    w = Window.partitionBy("symbol").orderBy("session_no").rowsBetween(-(length - 1), 0)
    above = F.when(F.count("close").over(w) >= length, (F.col("close") > F.avg("close").over(w)).cast("double"))
    states = bars.select("symbol", "date", "session_no", above.alias("_above"))
    own = Window.partitionBy("symbol").orderBy("session_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_above", ignorenulls=True).over(own)
    moved = F.when(F.col("_above").isNotNull(), F.col("_above") - F.coalesce(before, F.lit(0.0)))
    born = F.when(F.col("_above").isNotNull() & before.isNull(), 1)
    per = states.select("date", "session_no", moved.alias("_m"), born.alias("_b")).groupBy("date", "session_no").agg(
        F.coalesce(F.sum("_m"), F.lit(0.0)).alias("_m"), F.coalesce(F.sum("_b"), F.lit(0)).alias("_b"))
    upto = Window.partitionBy(F.lit(1)).orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("date", "session_no", F.sum("_m").over(upto).alias("_m"), F.sum("_b").over(upto).alias("names"))
    return run.filter("names > 0").select("date", "session_no", (F.col("_m") / F.col("names")).alias("breadth"), "names")


def cross_section_per_day(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date").agg(F.count("close").alias("names"))


def survivor_counts(bars: DataFrame) -> DataFrame:
    """Names of the first year, names on the last session, and first-year names that are gone by then."""
    span = bars.select(F.struct(F.year(F.min("date")).alias("y"), F.max("date").alias("d")))
    first = bars.filter(F.year("date") == span.scalar()["y"]).select("symbol").distinct().withColumn("early", F.lit(1))
    last = bars.filter(F.col("date") == span.scalar()["d"]).select("symbol").distinct().withColumn("late", F.lit(1))
    both = first.join(last, "symbol", "full")
    return both.agg(F.count("early").alias("first_year"), F.count("late").alias("at_end"),
                    F.count_if(F.col("late").isNull()).alias("retained_gone"))


def listing_age_filter(scored: DataFrame, least_days: int) -> DataFrame:
    """Only names listed for at least ``least_days`` at the row's date stay eligible."""
    born = F.min("date").over(Window.partitionBy("symbol"))
    return scored.withColumn("eligible", F.col("eligible") & (F.datediff("date", born) >= least_days))
