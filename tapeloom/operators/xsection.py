"""Cross-sectional eligibility, ranking, scoring and selection for all dates at once.

A date's cross-section may be very wide, so full ranks and medians go through the range-ordered helpers; top-n
selections are ``row_number() <= n`` filters, which Spark limits per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions.frames import finite, lookback, median_of, ratio
from tapeloom.functions.moving import Moving, moving_of_bars
from tapeloom.plans import ordered, sections
from tapeloom.session import settle


@dataclass(frozen=True)
class ScreenParams:
    look: int = 252
    skip: int = 21
    turnover_window: int = 60
    min_turnover: float = 1e7
    min_price: float = 10.0


def eligibility(panel: DataFrame, p: ScreenParams = ScreenParams()) -> DataFrame:
    """Add the momentum score and whether the name may be ranked on the date."""
    ends = lookback("close", p.skip).isNotNull() & lookback("close", p.look).isNotNull()
    ok = (F.col("close") >= p.min_price) & ends & finite(F.col("close"))
    stepped = panel.withColumns({"score": ind.momentum(p.look, p.skip), "_ok": ok})
    traded = moving_of_bars(stepped, {"_traded": Moving("median", "turnover", p.turnover_window, p.turnover_window // 2, by_order=True)})
    return traded.withColumn("eligible", F.coalesce(F.col("_ok") & (F.col("_traded") >= p.min_turnover), F.lit(False))).drop("_ok", "_traded")


def top_n(df: DataFrame, n: int, group: Sequence[str] = ("date",), order: Sequence[Column] | None = None,
          name: str = "rank") -> DataFrame:
    """The first ``n`` rows per group; each task keeps at most ``n`` before the shuffle."""
    order = order or [F.col("score").desc(), F.col("symbol").asc()]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n)


def rank_top_n(scored: DataFrame, n: int) -> DataFrame:
    """Best eligible names per date, ties by symbol; a score that is no finite number is never ranked."""
    return top_n(scored.filter(F.col("eligible") & finite(F.col("score"))), n)


def winsorised_z(df: DataFrame, group: Sequence[str], key: str, cols: Sequence[str], limit: float = 3.0,
                 keep: Sequence[str] = ()) -> DataFrame:
    """(group, key, ``keep``, z_<col>…): median/MAD scores clipped at ±limit; population z when the MAD is zero; null → 0.

    A group is scored as arrays in one task, all columns at once; groups too wide for that are laid out by ranges.
    """
    ids, cols = [*group, key, *keep], list(cols)
    df = settle(df, *ids, *cols)
    rows = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    schema = T.StructType([*(df.schema[c] for c in ids), *(T.StructField(f"z_{c}", T.DoubleType()) for c in cols)])

    def work(table: pa.Table) -> pa.Table:
        scores = [pa.array(_z_of_group(*sections.values(table, c), limit)) for c in cols]
        return pa.Table.from_arrays([*(table.column(c) for c in ids), *scores], names=schema.names)

    return sections.sections(rows, group, work, schema, lambda wide: _z_by_ranges(wide, group, ids, cols, limit))


def _z_of_group(x: np.ndarray, known: np.ndarray, limit: float) -> np.ndarray:
    """Scores of one group. Mean and deviation are taken about the median, so equal values deviate by exactly zero."""
    out = np.zeros(len(x))
    if not known.any():
        return out
    off = x[known] - sections.median(x[known])
    mad, sd = sections.median(np.abs(off)), off.std()
    if not mad <= 0:
        out[known] = np.fmax(np.fmin(off / (1.4826 * mad), limit), -limit)
    elif not sd <= 0:
        out[known] = np.fmax(np.fmin((off - off.mean()) / sd, limit), -limit)
    return out


def _z_by_ranges(df: DataFrame, group: Sequence[str], ids: Sequence[str], cols: Sequence[str], limit: float) -> DataFrame:
    """The same in one long form, for groups of any size: any number of columns costs two exact-median passes."""
    entries = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in cols])
    long = df.select(*ids, F.explode(entries).alias("e")).select(*ids, "e.factor", "e.x")
    by = [*group, "factor"]
    centre = ordered.quantiles(long, by, "x", {"_med": 0.5})
    moments = long.groupBy(*by).agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_sd"))
    spread = long.join(centre, by).withColumn("_dev", F.abs(F.col("x") - F.col("_med")))
    mad = ordered.quantiles(spread, by, "_dev", {"_mad": 0.5})
    m = long.join(moments.join(centre, by, "left").join(mad, by, "left"), by, "left")
    raw = (F.when(F.col("_mad") > 0, (F.col("x") - F.col("_med")) / (1.4826 * F.col("_mad")))
           .when(F.col("_sd") > 0, (F.col("x") - F.col("_mean")) / F.col("_sd")))
    z = F.when(raw.isNull(), F.lit(0.0)).otherwise(F.greatest(F.least(raw, F.lit(limit)), F.lit(-limit)))
    scored = m.select(*ids, "factor", z.alias("z"))
    return scored.groupBy(*ids).agg(*[F.max(F.when(F.col("factor") == c, F.col("z"))).alias(f"z_{c}") for c in cols])


# Default gates.
@dataclass(frozen=True)
class GateParams:
    min_bars: int = 500
    min_price: float = 50.0
    max_price: float = 15000.0
    min_turnover: float = 5e7
    max_zero_volume: float = 0.05
    max_participation_pct: float = 1.0
    notional: float = 40000.0


def with_first_failed_gate(f: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Name of the first hard gate a row fails, ``survived`` otherwise; a missing value fails its gate."""
    part = 100.0 * ratio(ratio(F.lit(p.notional), F.col("close")), F.col("median_volume"))
    gates = {"history": F.col("bars") >= p.min_bars,
             "price": F.col("close").between(p.min_price, p.max_price),
             "turnover": F.col("median_turnover") >= p.min_turnover,
             "zero_volume": F.col("zero_volume_frac") <= p.max_zero_volume,
             "atr": finite(F.col("atr_pct")) & (F.col("atr_pct") > 0),
             "participation": F.col("participation_pct") <= p.max_participation_pct}
    verdict = F.lit("survived")
    for name, ok in reversed(gates.items()):
        verdict = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(verdict)
    return f.withColumn("participation_pct", part).withColumn("gate", verdict)


def gate_report(f: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    return with_first_failed_gate(f, p).groupBy("date", "gate").agg(F.count(F.lit(1)).alias("names"))


# Factor weights per regime family.
REGIME_WEIGHTS = {
    "trend": {"rs": 0.32, "trend": 0.22, "range": 0.22, "liquidity": 0.14, "expansion": 0.10},
    "range": {"rs": 0.10, "trend": 0.10, "range": 0.42, "liquidity": 0.24, "expansion": 0.14},
    "volatile": {"rs": 0.18, "trend": 0.20, "range": 0.20, "liquidity": 0.32, "expansion": 0.10},
}


def regime_score(f: DataFrame, default: str = "trend") -> DataFrame:
    """Composite score of rows that carry ``family`` and ``direction`` of their date."""
    def weight(block: str) -> Column:
        w = F.lit(REGIME_WEIGHTS[default][block])
        for fam, ws in REGIME_WEIGHTS.items():
            w = F.when(F.col("family") == fam, F.lit(ws[block])).otherwise(w)
        return w
    zero = F.lit(0.0)
    d = F.col("direction")
    # Blend of the return horizons.
    rs = (0.40 * F.coalesce("ret_medium", zero) + 0.35 * F.coalesce("ret_long", zero) + 0.25 * F.coalesce("ret_year_skip", zero))
    raw = f.withColumns({
        "rs": F.when(d == 0, F.abs(rs)).when(d < 0, -rs).otherwise(rs),
        "cleanness": F.col("efficiency_ratio"),
        "slope": F.col("slope_r2") * F.when(d == 0, 1).otherwise(d),
        "range": F.coalesce("range_pct", zero) - 0.5 * F.coalesce("gap_pct", zero),
        "liquidity": F.log10(F.greatest("median_turnover", F.lit(1.0))),
        "expansion": F.col("turnover_expansion")})
    blocks = ["rs", "cleanness", "slope", "range", "liquidity", "expansion"]
    scored = winsorised_z(raw, ["date"], "symbol", blocks, keep=["family"])
    trend = 0.5 * F.col("z_cleanness") + 0.5 * F.col("z_slope")
    total = (weight("rs") * F.col("z_rs") + weight("trend") * trend + weight("range") * F.col("z_range")
             + weight("liquidity") * F.col("z_liquidity") + weight("expansion") * F.col("z_expansion"))
    return scored.withColumn("z_trend", trend).withColumn("score", total)


def with_known_regime(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """Rows with the family and direction of the session before theirs, the last one known when the row is decided on.

    ``regimes`` has one row per session, so it is broadcast; rows without a regime before them are left out.
    """
    known = regimes.select((F.col("session_no") + 1).alias("session_no"), "family", "direction")
    return rows.join(F.broadcast(known), "session_no")


def select_universe(f: DataFrame, size: int = 250, p: GateParams = GateParams()) -> DataFrame:
    """Gate, score and keep the best ``size`` names per date; scores that differ in the order of additions only are equal."""
    passed = with_first_failed_gate(f, p).filter(F.col("gate") == "survived")
    return top_n(regime_score(passed), size, order=[F.round("score", 9).desc(), F.col("symbol").asc()])


def summarise_liquidity(bars: DataFrame, tail: int = 60) -> DataFrame:
    """Medians over the last ``tail`` bars of each series, with its total bar count."""
    recent = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    counted = bars.withColumns({"_n": F.row_number().over(recent), "bars": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    last = counted.filter(F.col("_n") <= tail)
    vol = F.coalesce("volume", F.lit(0.0))
    return last.groupBy("symbol").agg(
        F.max("bars").alias("bars"), F.min_by("close", "_n").alias("last_close"), median_of(vol).alias("median_volume"),
        median_of(F.col("close") * vol).alias("median_turnover"))


def liquidity_prefilter(liquidity: DataFrame, floor: float, low: float, high: float) -> DataFrame:
    return liquidity.filter((F.col("median_turnover") >= 0.5 * floor) & F.col("last_close").between(low, high))


def prefilter_semi(bars: DataFrame, survivors: DataFrame) -> DataFrame:
    """Full history only for names that passed the cheap screen."""
    return bars.join(survivors.select("symbol"), "symbol", "left_semi")


@dataclass(frozen=True)
class TrendRules:
    rank_window: int = 90
    trend_ma: int = 100
    index_ma: int = 200
    gap_window: int = 90
    max_gap: float = 0.15
    exit_rank_pct: float = 20.0
    atr_window: int = 20
    stop_mult: float = 3.0
    turnover_window: int = 100
    min_history: int = 100
    min_price: float = 50.0
    max_price: float = 15000.0
    min_turnover: float = 5e7
    per_year: int = 252


def clenow_investable(panel: DataFrame, r: TrendRules = TrendRules()) -> DataFrame:
    """Regression-slope score and the standing floors; entries additionally need trend and gap (``entry_ok``)."""
    w = Window.partitionBy("symbol").orderBy("session_no")
    hist = F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev = lookback("close", 1)
    # All windows come first: after a pass through Python Spark no longer knows that the series lie whole.
    steps = ind.atr_wilder(panel.withColumns({
        "_gap": F.abs((F.col("open") - prev) / F.when(prev > 0, prev)), "_y": F.log(F.when(F.col("close") > 0, F.col("close"))),
        "_turnover": F.col("close") * F.col("volume"), "history": hist, "_number": F.row_number().over(w)}), r.atr_window)
    cols = moving_of_bars(steps, {
        "max_gap": Moving("max", "_gap", r.gap_window, max(2, r.gap_window // 2), by_order=True),
        "trend_ma": Moving("mean", "close", r.trend_ma, r.trend_ma, by_order=True),
        "median_turnover": Moving("median", "_turnover", r.turnover_window, max(2, r.turnover_window // 2), by_order=True),
        "_slope": Moving("slope", "_y", r.rank_window, by_order=True), "_r2": Moving("r2", "_y", r.rank_window, by_order=True)}, bars="_number")
    cols = cols.withColumn("score", ind.annualised(F.col("_slope"), F.col("_r2"), r.per_year)).drop("_gap", "_y", "_turnover", "_number", "_slope", "_r2")
    inv = (F.col("score").isNotNull() & (F.col("history") >= r.min_history) & F.col("close").between(r.min_price, r.max_price)
           & (F.col("median_turnover") >= r.min_turnover) & (F.col("atr") > 0))
    out = cols.withColumn("investable", F.coalesce(inv, F.lit(False)))
    entry = F.col("investable") & (F.col("close") > F.col("trend_ma")) & (F.col("max_gap") <= r.max_gap)
    return out.withColumn("entry_ok", F.coalesce(entry, F.lit(False)))


def market_filter(index: DataFrame, length: int) -> DataFrame:
    """Index above its own full-window mean, per session; one row per session, so one window partition is bounded."""
    w = Window.orderBy("session_no").rowsBetween(-(length - 1), 0)
    ma = F.when(F.count("close").over(w) >= length, F.avg("close").over(w))
    return index.select("date", F.coalesce(F.col("close") > ma, F.lit(False)).alias("market_ok"))


def market_filter_join(rows: DataFrame, market: DataFrame) -> DataFrame:
    """Attach the index reading by date; a date without one is not tradeable. One row per session: broadcast."""
    return rows.join(F.broadcast(market), "date", "left").withColumn("market_ok", F.coalesce("market_ok", F.lit(False)))


def clenow_ranking(rows: DataFrame) -> DataFrame:
    """Rank among investable names per date and the size of the cross-section."""
    return ordered.row_numbers(rows.filter("investable"), ["date"], [F.col("score").desc(), F.col("symbol").asc()])


def clenow_exit_reason(holdings: DataFrame, rows: DataFrame, r: TrendRules = TrendRules()) -> DataFrame:
    """Why each holding should be closed on its date, null to keep it (also when there is no bar that day)."""
    rows = settle(rows, "date", "symbol", "score", "close", "investable", "trend_ma", "max_gap")
    ranks = clenow_ranking(rows.select("date", "symbol", "score", "investable")).select("date", "symbol", "rank")
    sizes = rows.filter("investable").groupBy("date").agg(F.count(F.lit(1)).alias("size"))
    known = rows.select("symbol").distinct().withColumn("known", F.lit(True))
    cols = rows.select("date", "symbol", "close", "investable", "trend_ma", "max_gap")
    h = (holdings.join(known, "symbol", "left").join(cols, ["date", "symbol"], "left")
         .join(ranks, ["date", "symbol"], "left").join(F.broadcast(sizes), "date", "left"))
    cutoff = F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) * r.exit_rank_pct / 100.0))
    reason = (F.when(F.col("known").isNull(), "delisted").when(F.col("close").isNull(), None)
              .when(~F.col("investable"), "not_investable").when(F.col("close") < F.col("trend_ma"), "below_trend_ma")
              .when(F.col("max_gap") > r.max_gap, "gapped")
              .when(F.col("rank").isNull() | (F.col("rank") > cutoff), "rank_dropped"))
    return h.select("date", "symbol", reason.alias("reason"))


def atr_stop_levels(rows: DataFrame, mult: float = 3.0) -> DataFrame:
    """Initial stop and ratchet over each holding spell (an unbroken run of ``entry_ok`` bars)."""
    w = Window.partitionBy("symbol").orderBy("session_no")
    before = F.coalesce(F.lag("entry_ok").over(w), F.lit(False))
    spell = F.sum((F.col("entry_ok") & ~before).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("spell", spell.cast("long")).filter("entry_ok")
    stop = F.col("close") - mult * F.col("atr")
    inside = Window.partitionBy("symbol", "spell").orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumns({"initial_stop": F.first(stop).over(inside), "trail_stop": F.max(stop).over(inside)})


def rebalance_dates(scored: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th session from the first one with any score, numbered."""
    first = scored.filter(F.col("score").isNotNull()).select(F.min("session_no"))
    days = scored.select("date", "session_no").distinct()
    off = F.col("session_no") - first.scalar()
    return days.filter((off >= 0) & (F.pmod(off, F.lit(step)) == 0)).withColumn("rebalance_no", (off / step).cast("int"))


def weekday_dates(scored: DataFrame, weekday: int) -> DataFrame:
    """Sessions on one weekday, Monday = 0."""
    return scored.filter(F.weekday("date") == weekday).select("date", "session_no").distinct()


def targets(scored: DataFrame, n: int, step: int) -> DataFrame:
    """Best names on each rebalance session; the calendar of rebalances is small and broadcast."""
    days = F.broadcast(rebalance_dates(scored, step).select("date", "rebalance_no"))
    return rank_top_n(scored.join(days, "date"), n).select("rebalance_no", "date", "session_no", "symbol", "rank", "score")


def target_holdings(scored: DataFrame, n: int, step: int) -> DataFrame:
    """Names entered, kept and left at each rebalance against the previous target."""
    scored = settle(scored, "symbol", "date", "session_no", "score", "eligible")
    t = targets(scored, n, step).select("rebalance_no", "symbol")
    prev = t.select((F.col("rebalance_no") + 1).alias("rebalance_no"), "symbol", F.lit(1).alias("_was"))
    both = t.withColumn("_is", F.lit(1)).join(prev, ["rebalance_no", "symbol"], "full")
    days = rebalance_dates(scored, step).select("rebalance_no", "date")
    change = F.when(F.col("_was").isNull(), "entered").when(F.col("_is").isNull(), "left").otherwise("kept")
    return both.select("rebalance_no", "symbol", change.alias("change")).join(F.broadcast(days), "rebalance_no")


def holding_returns(t: DataFrame, panel: DataFrame, hold: str = "_until", keys: Sequence[str] = ()) -> DataFrame:
    """Session-exact returns of the target names on every session after the decision up to ``hold``."""
    rets = panel.select("symbol", "session_no", "date", (ratio(F.col("close"), lookback("close", 1)) - 1).alias("ret"))
    spread = t.select(*keys, "symbol", F.explode(F.sequence(F.col("session_no") + 1, F.col(hold))).alias("session_no"))
    return spread.join(rets, ["symbol", "session_no"])


def traded_weight(t: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Names that entered or left at each rebalance after the first, as a share of ``n``."""
    by = [*keys, "rebalance_no"]
    now = t.select(*by, "symbol", F.lit(1).alias("_is"))
    was = t.select(*keys, (F.col("rebalance_no") + 1).alias("rebalance_no"), "symbol", F.lit(1).alias("_was"))
    both = now.join(was, [*by, "symbol"], "full")
    return both.groupBy(*by).agg((F.count_if(F.col("_is").isNull() | F.col("_was").isNull()) / n).alias("traded"))


def holdings_days(t: DataFrame, days: DataFrame, panel: DataFrame, n: int, step: int, cost_bps: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Daily equal-weight return of any targets (keys, rebalance_no, session_no, symbol), gross and less the cost of trading.

    The one engine for a strategy and for the random selections it is measured against.
    """
    t = settle(t, *keys, "rebalance_no", "session_no", "symbol")
    held = holding_returns(t.withColumn("_until", F.col("session_no") + step), panel, keys=keys)
    daily = held.groupBy(*keys, "session_no", "date").agg(F.avg("ret").alias("gross"), F.count("ret").alias("names"))
    after = days.select("rebalance_no", (F.col("session_no") + 1).alias("session_no"))
    traded = traded_weight(t, n, keys).join(F.broadcast(after), "rebalance_no").drop("rebalance_no")
    out = daily.join(traded, [*keys, "session_no"], "left").withColumn("traded", F.coalesce("traded", F.lit(0.0)))
    return out.withColumn("net", F.coalesce("gross", F.lit(0.0)) - F.col("traded") * cost_bps / 1e4)


def holdings_return_curve(scored: DataFrame, n: int, step: int, cost_bps: float = 0.0) -> DataFrame:
    """Equal-weight return of the target names from the session after each decision, cost drag on traded weight."""
    scored = settle(scored, "symbol", "date", "session_no", "close", "score", "eligible")
    return compound(holdings_days(targets(scored, n, step), rebalance_dates(scored, step), scored, n, step, cost_bps), "net", "curve")


def compound(daily: DataFrame, ret: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Growth of one unit; the frame has one row per session and series."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn(name, F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(w)))


@dataclass(frozen=True)
class RankingRule:
    """A cross-sectional rule: panel rows to (symbol, date, score, investable, entry_ok) rows."""

    name: str
    score: Callable[[DataFrame], DataFrame]


def rank_with(rules: Sequence[RankingRule], panel: DataFrame, n: int) -> DataFrame:
    """Best ``n`` enterable names per rule and date; the panel is read by every rule, so it is settled."""
    panel = settle(panel)
    out = None
    for rule in rules:
        rows = rule.score(panel).filter(F.col("entry_ok") & finite(F.col("score"))).select(F.lit(rule.name).alias("rule"), "date", "symbol", "score")
        out = rows if out is None else out.unionByName(rows)
    return top_n(out, n, ["rule", "date"])


def grid_returns(scored: DataFrame, cells: DataFrame) -> DataFrame:
    """Every (n, step) cell of a small grid in one pass: rank once, explode the cells a row belongs to.

    ``cells``: one row holding an array of (n, step) structs; its largest n bounds the ranks that are kept.
    """
    scored = settle(scored, "symbol", "date", "session_no", "close", "score", "eligible")
    most = max((c["n"] for c in cells.first()[0]), default=0)
    first = scored.filter(F.col("score").isNotNull()).select(F.min("session_no"))
    last = scored.select(F.max("session_no"))
    best = rank_top_n(scored.filter(F.col("session_no") >= first.scalar()), most)
    off = F.col("session_no") - first.scalar()
    hit = (best.select("symbol", "session_no", "rank", off.alias("_off"), F.explode(cells.scalar()).alias("c"))
           .select("symbol", "session_no", "rank", "_off", "c.n", "c.step", "c.phase")
           .filter((F.col("rank") <= F.col("n")) & (F.pmod(F.col("_off"), F.col("step")) == F.col("phase"))))
    t = hit.withColumn("_until", F.least(F.col("session_no") + F.col("step"), last.scalar())).filter(F.col("_until") > F.col("session_no"))
    rets = holding_returns(t, scored, keys=["n", "step", "phase"])
    daily = rets.groupBy("n", "step", "phase", "session_no").agg(F.avg("ret").alias("ret"))
    return daily.groupBy("n", "step", "phase").agg(
        F.count("ret").alias("sessions"), (100 * (F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0))))) - 1)).alias("total_pct"))
