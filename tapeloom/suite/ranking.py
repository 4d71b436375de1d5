"""Cross-sectional ranking, selection, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.operators import calendars as cal
from tapeloom.operators import xsection as xs
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.indicators import FACT, O, ROWS, W, factors, fold
from tapeloom.suite.register import query

SCREEN = xs.ScreenParams(look=52, skip=4, turnover_window=12, min_turnover=26000, min_price=600)
GATES = xs.GateParams(min_bars=65, min_price=300, max_price=1500, min_turnover=26000, notional=500, max_participation_pct=1.0)
RULES = xs.TrendRules(rank_window=4, trend_ma=3, index_ma=40, gap_window=12, max_gap=0.9, exit_rank_pct=20.0, atr_window=14, stop_mult=3.0,
                      turnover_window=12, min_history=30, min_price=300, max_price=2000, min_turnover=20000, per_year=52)


def scored(spark, sf):
    return xs.eligibility(src.panel(spark, sf).drop("open", "high", "low", "volume"), SCREEN)


@query("eligibility", f"WITH {q.MOM} SELECT symbol, session_no, eligible, round(score, 8)+0.0 AS score FROM elig")
def _(spark, sf):
    return scored(spark, sf).select("symbol", "session_no", "eligible", fixed(F.col("score"), 8).alias("score"))


@query("rank_top_n", f"""WITH {q.MOM} SELECT date, symbol, round(score, 8) AS score, row_number() OVER w AS rank FROM elig WHERE eligible AND score IS NOT NULL
WINDOW w AS (PARTITION BY date ORDER BY score DESC, symbol) QUALIFY row_number() OVER w <= 10""")
def _(spark, sf):
    return xs.rank_top_n(scored(spark, sf), 10).select("date", "symbol", fixed(F.col("score"), 8).alias("score"), F.col("rank").cast("long").alias("rank"))


def zsql(src_sql, cols, by="date"):
    """Textbook median/MAD scores with plain windows."""
    parts = []
    for c in cols:
        parts.append(f"median({c}) OVER (PARTITION BY {by}) AS m_{c}, avg({c}) OVER (PARTITION BY {by}) AS a_{c}, stddev_pop({c}) OVER (PARTITION BY {by}) AS s_{c}")
    mads = [f"median(abs({c}-m_{c})) OVER (PARTITION BY {by}) AS d_{c}" for c in cols]
    zs = [f"""coalesce(CASE WHEN {c} IS NULL THEN 0 WHEN d_{c}>0 THEN greatest(least(({c}-m_{c})/(1.4826*d_{c}), 3.0), -3.0)
      WHEN s_{c}>0 THEN greatest(least(({c}-a_{c})/s_{c}, 3.0), -3.0) ELSE 0 END, 0) AS z_{c}""" for c in cols]
    return f"z0 AS (SELECT *, {', '.join(parts)} FROM {src_sql}), z1 AS (SELECT *, {', '.join(mads)} FROM z0), z2 AS (SELECT *, {', '.join(zs)} FROM z1)"


@query("winsorised_z", f"WITH {q.MOM}, {zsql('mom', ['score', 'close'])} SELECT date, symbol, round(z_score, 6)+0.0 AS z_score, round(z_close, 6)+0.0 AS z_close FROM z2")
def _(spark, sf):
    z = xs.winsorised_z(scored(spark, sf), ["date"], "symbol", ["score", "close"])
    return z.select("date", "symbol", fixed(F.col("z_score")).alias("z_score"), fixed(F.col("z_close")).alias("z_close"))


GATED = FACT + """, gt AS (SELECT *, CASE WHEN bars<65 THEN 'history' WHEN NOT (close BETWEEN 300 AND 1500) THEN 'price' WHEN NOT coalesce(median_turnover>=26000, false) THEN 'turnover'
 WHEN NOT coalesce(zero_volume_frac<=0.05, false) THEN 'zero_volume' WHEN NOT coalesce(atr_pct>0, false) THEN 'atr' WHEN NOT coalesce(100.0*(500/close)/median_volume<=1.0, false) THEN 'participation' ELSE 'survived' END AS gate,
 ['trend','range','volatile'][1+session_no%3] AS family, session_no%5%3-1 AS direction FROM factors)"""


@query("gate_report", f"WITH {GATED} SELECT date, gate, count(*) AS names FROM gt GROUP BY ALL")
def _(spark, sf):
    return xs.gate_report(factors(spark, sf), GATES)


def regimed(spark, sf):
    fam = F.element_at(F.array(F.lit("trend"), F.lit("range"), F.lit("volatile")), (1 + F.col("session_no") % 3).cast("int"))
    return factors(spark, sf).withColumns({"family": fam, "direction": F.col("session_no") % 5 % 3 - 1})


def score_sql(base):
    raw = f"""rw AS (SELECT date, symbol, family, CASE WHEN direction=0 THEN abs(rs0) WHEN direction<0 THEN -rs0 ELSE rs0 END AS rs, efficiency_ratio AS cl,
 slope_r2*CASE WHEN direction=0 THEN 1 ELSE direction END AS sl, range_pct-0.5*gap_pct AS rg, log10(greatest(median_turnover, 1.0)) AS lq, turnover_expansion AS ex
 FROM (SELECT *, 0.40*coalesce(ret_medium,0)+0.35*coalesce(ret_long,0)+0.25*coalesce(ret_year_skip,0) AS rs0 FROM {base}))"""
    wt = "w(family, wr, wt, wg, wl, we) AS (VALUES ('trend',0.32,0.22,0.22,0.14,0.10),('range',0.10,0.10,0.42,0.24,0.14),('volatile',0.18,0.20,0.20,0.32,0.10))"
    return f"""{raw}, {wt}, {zsql('rw', ['rs', 'cl', 'sl', 'rg', 'lq', 'ex'])},
sc AS (SELECT date, symbol, z_rs, 0.5*z_cl+0.5*z_sl AS z_trend, z_rg AS z_range, z_lq AS z_liquidity, z_ex AS z_expansion,
 wr*z_rs+wt*(0.5*z_cl+0.5*z_sl)+wg*z_rg+wl*z_lq+we*z_ex AS score FROM z2 JOIN w USING (family))"""


_ZC = ("z_rs", "z_trend", "z_range", "z_liquidity", "z_expansion", "score")


@query("regime_score", f"WITH {GATED}, {score_sql('gt')} SELECT date, symbol, {', '.join(f'round({c}, 5)+0.0 AS {c}' for c in _ZC)} FROM sc")
def _(spark, sf):
    return xs.regime_score(regimed(spark, sf)).select("date", "symbol", *[fixed(F.col(c), 5).alias(c) for c in _ZC])


@query("select_universe", f"""WITH {GATED}, ok AS (SELECT * FROM gt WHERE gate='survived'), {score_sql('ok')}
SELECT date, symbol, round(score, 5)+0.0 AS score FROM sc QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, symbol) <= 15""")
def _(spark, sf):
    return xs.select_universe(regimed(spark, sf), 15, GATES).select("date", "symbol", fixed(F.col("score"), 5).alias("score"))


LIQ = q.WBARS + """, lr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n, count(*) OVER (PARTITION BY symbol) AS bars FROM wbars),
liq AS (SELECT symbol, max(bars) AS bars, min_by(close, n) AS last_close, median(volume) AS median_volume, median(close*volume) AS median_turnover FROM lr WHERE n<=60 GROUP BY 1)"""


@query("summarise_liquidity", f"WITH {LIQ} SELECT symbol, bars, last_close, median_volume, round(median_turnover, 7) AS median_turnover FROM liq")
def _(spark, sf):
    return xs.summarise_liquidity(src.weekly_bars(spark, sf)).withColumn("median_turnover", fixed(F.col("median_turnover"), 7))


def _survivors(spark, sf):
    return xs.liquidity_prefilter(xs.summarise_liquidity(src.weekly_bars(spark, sf)), 70000, 500, 1000)


@query("liquidity_prefilter", f"WITH {LIQ} SELECT symbol, last_close FROM liq WHERE median_turnover>=35000 AND last_close BETWEEN 500 AND 1000")
def _(spark, sf):
    return _survivors(spark, sf).select("symbol", "last_close")


@query("prefilter_semi", f"WITH {LIQ} SELECT symbol, date, close FROM wbars WHERE symbol IN (SELECT symbol FROM liq WHERE median_turnover>=35000 AND last_close BETWEEN 500 AND 1000)")
def _(spark, sf):
    return xs.prefilter_semi(src.weekly_bars(spark, sf), _survivors(spark, sf)).select("symbol", "date", "close")


CLE = q.BENCH + f""", cg AS (SELECT p.*, abs((p.open-l.close)/l.close) AS gap, greatest(p.high-p.low, abs(p.high-lag(p.close) OVER pw), abs(p.low-lag(p.close) OVER pw)) AS tr
 FROM panel p LEFT JOIN panel l ON l.symbol=p.symbol AND l.session_no=p.session_no-1 WINDOW pw AS (PARTITION BY p.symbol ORDER BY p.session_no)),
cc AS (SELECT symbol, date, session_no, close, CASE WHEN count(*) {W.format(3)}=4 THEN (exp(greatest(least(52*regr_slope(ln(close), session_no) {W.format(3)}, 10), -10))-1)*least(regr_r2(ln(close), session_no) {W.format(3)}, 1.0) END AS score,
 CASE WHEN count(*) {W.format(2)}=3 THEN avg(close) {W.format(2)} END AS trend_ma, CASE WHEN count(*) {W.format(11)}>=6 THEN quantile_cont(close*volume, 0.5) {W.format(11)} END AS mt,
 count(*) {O} AS history, CASE WHEN count(gap) {W.format(11)}>=6 THEN max(gap) {W.format(11)} END AS max_gap, {fold('tr', '(1.0::DOUBLE/14)', 14, 'cg', 'atr')} FROM cg),
ci AS (SELECT *, coalesce(score IS NOT NULL AND history>=30 AND close BETWEEN 300 AND 2000 AND mt>=20000 AND atr>0, false) AS investable FROM cc),
cl AS (SELECT *, coalesce(investable AND close>trend_ma AND max_gap<=0.9, false) AS entry_ok FROM ci),
mk AS (SELECT date, coalesce(count(*) OVER mw>=40 AND close>avg(close) OVER mw, false) AS market_ok FROM bench WINDOW mw AS (ORDER BY session_no ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))"""


def clenow(spark, sf):
    return xs.clenow_investable(src.panel(spark, sf).drop("turnover"), RULES)


def market(spark, sf):
    return xs.market_filter(src.benchmark(src.panel(spark, sf)), RULES.index_ma)


@query("clenow_investable", f"WITH {CLE} SELECT symbol, session_no, investable, entry_ok, round(atr, 6) AS atr FROM cl")
def _(spark, sf):
    return clenow(spark, sf).select("symbol", "session_no", "investable", "entry_ok", fixed(F.col("atr")).alias("atr"))


@query("market_filter_join", f"WITH {CLE} SELECT symbol, date, market_ok FROM panel LEFT JOIN mk USING (date)")
def _(spark, sf):
    return xs.market_filter_join(src.panel(spark, sf), market(spark, sf)).select("symbol", "date", "market_ok")


@query("clenow_entries", f"WITH {CLE} SELECT symbol, date, market_ok FROM cl JOIN mk USING (date) WHERE entry_ok")
def _(spark, sf):
    return xs.market_filter_join(clenow(spark, sf).filter("entry_ok"), market(spark, sf)).select("symbol", "date", "market_ok")


@query("first_tradeable_date", f"WITH {CLE} SELECT min(date) AS date FROM cl JOIN mk USING (date) WHERE investable AND market_ok IS NOT NULL")
def _(spark, sf):
    return cal.first_tradeable_date(xs.market_filter_join(clenow(spark, sf), market(spark, sf)))


@query("clenow_ranking", f"WITH {CLE} SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY date) AS size FROM cl WHERE investable")
def _(spark, sf):
    return xs.clenow_ranking(clenow(spark, sf).select("date", "symbol", "score", "investable")).select("date", "symbol", "rank", "size")


@query("clenow_exit_reason", f"""WITH {CLE}, h AS (SELECT DISTINCT o_custkey%120 AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders),
rk AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM cl WHERE investable), sz AS (SELECT date, count(*) AS size FROM cl WHERE investable GROUP BY 1)
SELECT h.date, h.symbol, CASE WHEN h.symbol NOT IN (SELECT symbol FROM cl) THEN 'delisted' WHEN c.close IS NULL THEN NULL WHEN NOT c.investable THEN 'not_investable' WHEN c.close<c.trend_ma THEN 'below_trend_ma'
 WHEN c.max_gap>0.9 THEN 'gapped' WHEN rank IS NULL OR rank>greatest(1, ceil(coalesce(size,0)*0.2)) THEN 'rank_dropped' END AS reason
FROM h LEFT JOIN cl c USING (symbol, date) LEFT JOIN rk USING (symbol, date) LEFT JOIN sz USING (date)""")
def _(spark, sf):
    h = src.table(spark, sf, "orders").select((F.col("o_custkey") % 120).alias("symbol"), F.date_trunc("week", "o_orderdate").cast("date").alias("date")).distinct()
    return xs.clenow_exit_reason(h, clenow(spark, sf), RULES)


@query("atr_stop_levels", f"""WITH {CLE}, sp AS (SELECT *, sum(CAST(entry_ok AND NOT coalesce(prev, false) AS INT)) {O} AS spell FROM (SELECT *, lag(entry_ok) {O} AS prev FROM cl))
SELECT symbol, session_no, round(first_value(close-3*atr) OVER s, 7) AS initial_stop, round(max(close-3*atr) OVER s, 7) AS trail_stop FROM sp WHERE entry_ok
WINDOW s AS (PARTITION BY symbol, spell ORDER BY session_no)""")
def _(spark, sf):
    return xs.atr_stop_levels(clenow(spark, sf)).select("symbol", "session_no", fixed(F.col("initial_stop"), 7).alias("initial_stop"), fixed(F.col("trail_stop"), 7).alias("trail_stop"))


REB = q.MOM + """, f0 AS (SELECT min(session_no) AS s0 FROM mom WHERE score IS NOT NULL), ln AS (SELECT max(session_no) AS sl FROM panel),
reb AS (SELECT date, session_no, CAST((session_no-s0)//4 AS INTEGER) AS rebalance_no FROM cal, f0 WHERE session_no>=s0 AND (session_no-s0)%4=0),
tgt AS (SELECT rebalance_no, e.date, e.session_no, symbol, row_number() OVER (PARTITION BY rebalance_no ORDER BY score DESC, symbol) AS rank FROM elig e JOIN reb USING (date)
 WHERE eligible AND score IS NOT NULL QUALIFY rank<=10),
chg AS (SELECT coalesce(a.rebalance_no, b.rebalance_no+1) AS rebalance_no, coalesce(a.symbol, b.symbol) AS symbol,
 CASE WHEN b.symbol IS NULL THEN 'entered' WHEN a.symbol IS NULL THEN 'left' ELSE 'kept' END AS change FROM tgt a FULL JOIN tgt b ON a.symbol=b.symbol AND a.rebalance_no=b.rebalance_no+1),
ch AS (SELECT c.rebalance_no, symbol, change, date FROM chg c JOIN reb USING (rebalance_no)),
rt AS (SELECT p.symbol, p.session_no, p.date, p.close/l.close-1 AS ret FROM panel p LEFT JOIN panel l ON l.symbol=p.symbol AND l.session_no=p.session_no-1)"""


@query("rebalance_dates", f"WITH {REB} SELECT date, session_no, rebalance_no FROM reb")
def _(spark, sf):
    return xs.rebalance_dates(scored(spark, sf), 4)


@query("target_holdings", f"WITH {REB} SELECT * FROM ch")
def _(spark, sf):
    return xs.target_holdings(scored(spark, sf), 10, 4)


CURVE = REB + """, dl AS (SELECT r.session_no, r.date, avg(ret) AS gross, count(ret) AS names FROM tgt t JOIN rt r ON r.symbol=t.symbol AND r.session_no BETWEEN t.session_no+1 AND t.session_no+4 GROUP BY ALL),
td AS (SELECT session_no+1 AS session_no, count(*) FILTER (WHERE change<>'kept')/10 AS traded FROM chg JOIN reb USING (rebalance_no) GROUP BY 1),
nt AS (SELECT session_no, dl.date, gross, names, coalesce(traded, 0) AS traded, coalesce(gross, 0)-coalesce(traded, 0)*14.6/1e4 AS net FROM dl LEFT JOIN td USING (session_no)),
crv AS (SELECT *, exp(sum(ln(1+net)) OVER (ORDER BY session_no)) AS curve FROM nt)"""


@query("holdings_return_curve", f"WITH {CURVE} SELECT session_no, date, names, round(gross, 7)+0.0 AS gross, round(traded, 4) AS traded, round(net, 7)+0.0 AS net, round(curve, 6) AS curve FROM crv")
def _(spark, sf):
    c = xs.holdings_return_curve(scored(spark, sf), 10, 4, 14.6)
    return c.select("session_no", "date", "names", fixed(F.col("gross"), 7).alias("gross"), fixed(F.col("traded"), 4).alias("traded"), fixed(F.col("net"), 7).alias("net"), fixed(F.col("curve")).alias("curve"))


GRID = REB + """, bst AS (SELECT symbol, session_no, row_number() OVER (PARTITION BY session_no ORDER BY score DESC, symbol) AS rank, session_no-s0 AS off FROM elig, f0
 WHERE eligible AND score IS NOT NULL AND session_no>=s0 QUALIFY rank<=20),
cells(n, step, phase) AS (VALUES {cells}),
gd AS (SELECT n, step, phase, r.session_no, avg(ret) AS ret FROM bst b JOIN cells c ON b.rank<=c.n AND b.off%c.step=c.phase JOIN rt r ON r.symbol=b.symbol AND r.session_no BETWEEN b.session_no+1 AND b.session_no+c.step GROUP BY ALL),
gr AS (SELECT n, step, phase, count(ret) AS sessions, 100*(exp(sum(ln(1+coalesce(ret, 0))))-1) AS total_pct FROM gd GROUP BY ALL)"""
CELLS = [(n, s, 0) for n in (5, 10, 20) for s in (4, 12)]
PHASES = [(10, 5, ph) for ph in range(5)]


def _cells(spark, cells):
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("step"), F.lit(p).alias("phase")) for n, s, p in cells])
    return spark.range(1).select(rows)


def _sql_cells(cells):
    return ",".join(f"({n},{s},{p})" for n, s, p in cells)


@query("parameter_grid", f"WITH {GRID.replace('{cells}', _sql_cells(CELLS))} SELECT n, step, sessions, round(total_pct, 4) AS total_pct FROM gr")
def _(spark, sf):
    g = xs.grid_returns(scored(spark, sf), _cells(spark, CELLS))
    return g.select("n", "step", "sessions", fixed(F.col("total_pct"), 4).alias("total_pct"))


@query("weekday_spread", f"""WITH {GRID.replace('{cells}', _sql_cells(PHASES))} SELECT phase, sessions, round(total_pct, 4) AS total_pct,
round(max(total_pct) OVER () - min(total_pct) OVER (), 4) AS spread_pp FROM gr""")
def _(spark, sf):
    g = xs.grid_returns(scored(spark, sf), _cells(spark, PHASES))
    s = g.agg(F.max("total_pct") - F.min("total_pct"))
    return g.select("phase", "sessions", fixed(F.col("total_pct"), 4).alias("total_pct"), fixed(s.scalar(), 4).alias("spread_pp"))


@query("ranking_rule", f"""WITH {CLE}, r1 AS (SELECT 'regression' AS rule, date, symbol, score FROM cl WHERE entry_ok AND score IS NOT NULL),
r2 AS (SELECT 'skip_momentum' AS rule, p.date, p.symbol, a.close/b.close-1 AS score FROM panel p JOIN panel a ON a.symbol=p.symbol AND a.session_no=p.session_no-4 JOIN panel b ON b.symbol=p.symbol AND b.session_no=p.session_no-52 WHERE p.close>=600)
SELECT rule, date, symbol, row_number() OVER (PARTITION BY rule, date ORDER BY score DESC, symbol) AS rank FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) QUALIFY rank<=5""")
def _(spark, sf):
    from tapeloom.functions import indicators as ind
    ok = (F.col("close") >= 600).alias("investable")
    rules = [xs.RankingRule("regression", lambda p: xs.clenow_investable(p, RULES)),
             xs.RankingRule("skip_momentum", lambda p: p.select("symbol", "date", ind.momentum(52, 4).alias("score"), ok, ok.alias("entry_ok")))]
    return xs.rank_with(rules, src.panel(spark, sf), 5).select("rule", "date", "symbol", F.col("rank").cast("long").alias("rank"))
