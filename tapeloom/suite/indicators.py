"""Indicators and window functions on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.functions.frames import fixed
from tapeloom.functions.moving import Moving, moving_of_bars
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.register import query

WEEKLY = ind.FactorParams(short=4, medium=13, long=26, year=52, skip=4, atr=14, slope=26, efficiency=13, fast=5, slow=20, per_year=52)
W = "OVER (PARTITION BY symbol ORDER BY session_no RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
ROWS = "OVER (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
O = "OVER (PARTITION BY symbol ORDER BY session_no)"  # noqa: E741


def bars(spark, sf, *cols):
    """Only the columns that are read: what passes through Python or a layout is not pruned by Spark."""
    return src.panel(spark, sf).select("symbol", "session_no", *cols)


def out(df, *cols, digits=6):
    return df.select("symbol", "session_no", *[fixed(F.col(c), digits).alias(c) for c in cols])


@query("sma", f"WITH {q.PANEL} SELECT symbol, session_no, round(CASE WHEN count(close) {W.format(4)} = 5 THEN avg(close) {W.format(4)} END, 6) AS sma FROM panel")
def _(spark, sf):
    return out(src.panel(spark, sf).withColumn("sma", ind.sma("close", 5)), "sma")


TR = q.PANEL + f""", tr AS (SELECT *, greatest(high-low, abs(high-lag(close) {O}), abs(low-lag(close) {O})) AS tr FROM panel)"""


@query("true_range", f"WITH {TR} SELECT symbol, session_no, round(tr, 6) AS true_range FROM tr")
def _(spark, sf):
    return out(src.panel(spark, sf).withColumn("true_range", ind.true_range()), "true_range")


def fold(col, alpha, least, rel, alias):
    return f"""CASE WHEN count({col}) {O} >= {least} THEN list_reduce(list({col}) FILTER (WHERE {col} IS NOT NULL) {O}, lambda a, x: a + {alpha}*(x-a)) END AS {alias}"""


@query("atr_wilder", f"WITH {TR}, a AS (SELECT symbol, session_no, {fold('tr', '(1.0::DOUBLE/14)', 14, 'tr', 'atr')} FROM tr) SELECT symbol, session_no, round(atr, 6) AS atr FROM a")
def _(spark, sf):
    return out(ind.atr_wilder(bars(spark, sf, "high", "low", "close"), 14), "atr")


@query("ema", f"WITH {q.PANEL}, a AS (SELECT symbol, session_no, {fold('close', '(2.0::DOUBLE/11)', 1, 'panel', 'ema')} FROM panel) SELECT symbol, session_no, round(ema, 6) AS ema FROM a")
def _(spark, sf):
    return out(ind.ema(bars(spark, sf, "close"), 10), "ema")


@query("rolling_slope_r2", f"""WITH {q.PANEL}, s AS (SELECT symbol, session_no, count(*) {W.format(4)} AS n, regr_slope(ln(close), session_no) {W.format(4)} AS b,
 regr_r2(ln(close), session_no) {W.format(4)} AS r2 FROM panel)
SELECT symbol, session_no, round(CASE WHEN n=5 THEN (exp(greatest(least(52*b, 10), -10))-1)*least(r2, 1.0) END, 4)+0.0 AS slope_r2 FROM s""")
def _(spark, sf):
    return out(src.panel(spark, sf).withColumn("slope_r2", ind.rolling_slope_r2(5, 52)), "slope_r2", digits=4)


@query("rolling_median_turnover", f"WITH {q.PANEL} SELECT symbol, session_no, round(CASE WHEN count(close*volume) {W.format(11)} >= 6 THEN quantile_cont(close*volume, 0.5) {W.format(11)} END, 7) AS med FROM panel")
def _(spark, sf):
    return out(ind.with_median_turnover(bars(spark, sf, "close", "volume"), 12, "med"), "med", digits=7)


@query("max_abs_gap", f"""WITH {q.PANEL}, g AS (SELECT p.*, abs((p.open-l.close)/l.close) AS gap FROM panel p LEFT JOIN panel l ON l.symbol=p.symbol AND l.session_no=p.session_no-1)
SELECT symbol, session_no, round(CASE WHEN count(gap) {W.format(11)} >= 6 THEN max(gap) {W.format(11)} END, 6) AS max_gap FROM g""")
def _(spark, sf):
    return out(ind.with_max_abs_gap(src.panel(spark, sf), 12), "max_gap")


EFF = q.PANEL + f""", d AS (SELECT *, abs(close-lag(close) {O}) AS d, abs(close-lag(close, 13) {O}) AS net FROM panel),
eff AS (SELECT *, CASE WHEN sum(d) {ROWS.format(12)} > 0 THEN net/sum(d) {ROWS.format(12)} END AS eff FROM d)"""


@query("efficiency_ratio", f"WITH {EFF} SELECT symbol, session_no, round(eff, 6) AS efficiency FROM eff")
def _(spark, sf):
    return out(ind.with_efficiency_ratio(src.panel(spark, sf), 13), "efficiency")


@query("rolling_percentile", f"""WITH {q.PANEL}, n AS (SELECT *, row_number() {O} AS rn FROM panel)
SELECT a.symbol, a.session_no, round(CASE WHEN count(*)>=10 THEN (count(*) FILTER (WHERE b.close<a.close) + (count(*) FILTER (WHERE b.close=a.close)+1)/2)/count(*) END, 6) AS pct
FROM n a JOIN n b ON a.symbol=b.symbol AND b.rn BETWEEN a.rn-29 AND a.rn GROUP BY 1, 2""")
def _(spark, sf):
    return out(moving_of_bars(bars(spark, sf, "close"), {"pct": Moving("rank", "close", 30, 10)}), "pct")


@query("efficiency_percentile", f"""WITH {EFF}, n AS (SELECT *, row_number() {O} AS rn FROM eff),
c AS (SELECT a.symbol, a.rn, count(b.eff) AS n, count(*) FILTER (WHERE b.eff<a.eff) AS below FROM n a JOIN n b ON a.symbol=b.symbol AND b.rn BETWEEN a.rn-52 AND a.rn-1 GROUP BY 1, 2)
SELECT symbol, session_no, round(CASE WHEN eff IS NOT NULL AND c.n>=20 THEN 100.0*below/c.n END, 6) AS pct FROM n LEFT JOIN c USING (symbol, rn)""")
def _(spark, sf):
    e = ind.with_efficiency_ratio(bars(spark, sf, "close"), 13)
    return out(moving_of_bars(e, {"pct": Moving("below", "efficiency", 52, 20)}), "pct")


@query("momentum_12_1", f"WITH {q.MOM} SELECT symbol, session_no, round(score, 6) AS score FROM mom")
def _(spark, sf):
    return out(src.panel(spark, sf).withColumn("score", ind.momentum(52, 4)), "score")


FACT = EFF + f""", f AS (SELECT *, row_number() {O} AS bars, close/lag(close,4) {O}-1 AS ret_short, close/lag(close,13) {O}-1 AS ret_medium, close/lag(close,26) {O}-1 AS ret_long,
 lag(close,4) {O}/lag(close,52) {O}-1 AS ret_year_skip, (high-low)/close AS rng, abs(open-lag(close) {O})/lag(close) {O} AS gp,
 greatest(high-low, abs(high-lag(close) {O}), abs(low-lag(close) {O})) AS tr, close*volume AS tv, ln(close) AS y FROM eff),
fac AS (SELECT symbol, date, session_no, bars, close, ret_short, ret_medium, ret_long, ret_year_skip, eff AS efficiency_ratio,
 avg(rng) {ROWS.format(3)} AS range_pct, avg(gp) {ROWS.format(3)} AS gap_pct, quantile_cont(tv, 0.5) {ROWS.format(19)} AS median_turnover,
 quantile_cont(tv, 0.5) {ROWS.format(4)}/quantile_cont(tv, 0.5) {ROWS.format(19)} AS turnover_expansion, quantile_cont(volume, 0.5) {ROWS.format(19)} AS median_volume,
 avg(CAST(volume<=0 AS INT)) {ROWS.format(19)} AS zero_volume_frac,
 (exp(greatest(least(52*regr_slope(y, bars) {ROWS.format(25)}, 10), -10))-1)*least(regr_r2(y, bars) {ROWS.format(25)}, 1.0) AS slope_r2,
 {fold('tr', '(1.0::DOUBLE/14)', 14, 'f', 'atr')} FROM f),
factors AS (SELECT *, atr/close AS atr_pct FROM fac WHERE bars>=61 AND close>0)"""


def factors(spark, sf):
    return ind.compute_factors(src.panel(spark, sf), WEEKLY)


@query("horizon_returns", f"WITH {FACT} SELECT symbol, session_no, round(ret_short, 6) AS ret_short, round(ret_medium, 6) AS ret_medium, round(ret_long, 6) AS ret_long, round(ret_year_skip, 6) AS ret_year_skip FROM f")
def _(spark, sf):
    return out(ind.horizon_returns(src.panel(spark, sf), WEEKLY), "ret_short", "ret_medium", "ret_long", "ret_year_skip")


@query("range_gap_pct", f"WITH {FACT} SELECT symbol, session_no, round(range_pct, 6) AS range_pct, round(gap_pct, 6) AS gap_pct FROM fac")
def _(spark, sf):
    return out(ind.range_gap_pct(src.panel(spark, sf), WEEKLY), "range_pct", "gap_pct")


@query("liquidity_factors", f"""WITH {FACT} SELECT symbol, session_no, round(median_turnover, 8) AS median_turnover, round(turnover_expansion, 8) AS turnover_expansion,
round(median_volume, 8) AS median_volume, round(zero_volume_frac, 8) AS zero_volume_frac FROM fac""")
def _(spark, sf):
    return out(ind.liquidity_factors(bars(spark, sf, "close", "volume"), WEEKLY), "median_turnover", "turnover_expansion", "median_volume", "zero_volume_frac", digits=8)


_FCOLS = ("close", "ret_short", "ret_medium", "ret_long", "ret_year_skip", "efficiency_ratio", "slope_r2", "atr_pct", "range_pct", "gap_pct",
          "median_turnover", "turnover_expansion", "median_volume", "zero_volume_frac")


@query("compute_factors", f"WITH {FACT} SELECT symbol, session_no, bars, {', '.join(f'round({c}, 8) AS {c}' for c in _FCOLS)} FROM factors")
def _(spark, sf):
    return factors(spark, sf).select("symbol", "session_no", "bars", *[fixed(F.col(c), 8).alias(c) for c in _FCOLS])


@query("drawdown_curve", f"WITH {q.PANEL} SELECT symbol, session_no, round(close/max(close) {O}-1, 8) AS drawdown FROM panel")
def _(spark, sf):
    return out(ind.drawdown_curve(src.panel(spark, sf), "close", ["symbol"], "session_no"), "drawdown", digits=8)


@query("textbook_indicators", f"""WITH {q.PANEL}, m AS (SELECT *, close-lag(close) {O} AS mv, ln(close/lag(close) {O}) AS lr FROM panel),
u AS (SELECT *, CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END AS up, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END AS dn FROM m),
a AS (SELECT *, {fold('up', '(1.0::DOUBLE/14)', 14, 'u', 'au')}, {fold('dn', '(1.0::DOUBLE/14)', 14, 'u', 'ad')}, count(close) {ROWS.format(19)} AS n, count(lr) {ROWS.format(19)} AS nl,
 avg(close) {ROWS.format(19)} AS mid, stddev_samp(close) {ROWS.format(19)} AS sd, stddev_samp(lr) {ROWS.format(19)} AS lsd FROM u)
SELECT symbol, session_no, round(CASE WHEN ad=0 THEN 100.0 ELSE 100-100/(1+au/ad) END, 6) AS rsi, round(CASE WHEN n>=20 THEN mid END, 6) AS bb_mid,
round(CASE WHEN n>=20 THEN mid+2*sd END, 6) AS bb_upper, round(CASE WHEN n>=20 THEN mid-2*sd END, 6) AS bb_lower, round(CASE WHEN nl>=20 THEN lsd*sqrt(52) END, 6) AS realised_vol FROM a""")
def _(spark, sf):
    p = src.panel(spark, sf).select("symbol", "session_no", "close")
    full = ind.realised_vol(ind.bollinger(ind.rsi(p)), 20, 52)
    return out(full, "rsi", "bb_mid", "bb_upper", "bb_lower", "realised_vol", digits=6)


@query("grouped_scan_udf", f"WITH {q.PANEL}, a AS (SELECT symbol, session_no, {fold('close', '(2.0::DOUBLE/6)', 1, 'panel', 'fast')}, {fold('close', '(2.0::DOUBLE/21)', 20, 'panel', 'slow')} FROM panel) SELECT symbol, session_no, round(fast, 6) AS fast, round(slow, 6) AS slow FROM a")
def _(spark, sf):
    """Two recursions in one grouped scan."""
    p = src.panel(spark, sf).select("symbol", "session_no", "close")
    return out(ind.recursive_means(p, ["symbol"], "session_no", {"fast": ("close", 2 / 6, 1), "slow": ("close", 2 / 21, 20)}), "fast", "slow")
