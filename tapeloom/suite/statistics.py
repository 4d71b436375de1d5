"""Statistical aggregations on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.operators import calendars as cal
from tapeloom.operators import statistics as st
from tapeloom.operators import xsection as xs
from tapeloom.session import settle
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.ranking import CURVE, REB, scored
from tapeloom.suite.register import query

SP = st.SpreadParams(n_side=5, step=4, look=52, skip=4)
LAGS, YEAR = 4, 52

DEC = REB + """, parts(part, lo, hi) AS (SELECT 'full', 0, max(session_no) FROM panel UNION ALL SELECT 'first', 0, max(session_no)//2 FROM panel UNION ALL SELECT 'second', max(session_no)//2, max(session_no) FROM panel),
fo AS (SELECT part, e.session_no, symbol, score, count(*) OVER (PARTITION BY part, e.session_no) AS width,
 row_number() OVER (PARTITION BY part, e.session_no ORDER BY score, symbol) AS up, row_number() OVER (PARTITION BY part, e.session_no ORDER BY score DESC, symbol DESC) AS dn
 FROM {elig} e JOIN parts ON e.session_no > lo AND e.session_no <= hi WHERE eligible AND score IS NOT NULL AND e.session_no-lo>=54 AND (e.session_no-lo-54)%4=0),
bk AS (SELECT part, session_no AS formed, symbol, CASE WHEN dn<=5 THEN 1 ELSE -1 END AS side FROM fo WHERE width>=20 AND (up<=5 OR dn<=5)),
dsp AS (SELECT part, r.session_no, r.date, formed, avg(ret) FILTER (WHERE side=1) - avg(ret) FILTER (WHERE side=-1) AS spread
 FROM bk JOIN parts USING (part) JOIN rt r ON r.symbol=bk.symbol AND r.session_no BETWEEN formed AND formed+3 AND r.session_no<=hi WHERE ret IS NOT NULL GROUP BY ALL
 HAVING count(*) FILTER (WHERE side=1)>=2 AND count(*) FILTER (WHERE side=-1)>=2)"""
DECS = DEC.replace("{elig}", "elig")


def nw_sql(src_sql, value, lags, key="part", order="session_no", name="nw"):
    terms = "+".join(f"{2 * (1 - k / (lags + 1))}*coalesce(sum(e*e{k}),0)" for k in range(1, lags + 1))
    lagged = ", ".join(f"lag(e, {k}) OVER (PARTITION BY {key} ORDER BY {order}) AS e{k}" for k in range(1, lags + 1))
    return f"""{name}e AS (SELECT {key}, {order}, {value} AS x, {value}-avg({value}) OVER (PARTITION BY {key}) AS e FROM {src_sql} WHERE {value} IS NOT NULL),
{name}l AS (SELECT *, {lagged} FROM {name}e), {name}s AS (SELECT {key}, count(*) AS n, avg(x) AS mean, sqrt(greatest((sum(e*e)+{terms})/count(*), 0)/count(*)) AS se FROM {name}l GROUP BY 1),
{name} AS (SELECT {key}, n, CASE WHEN n>={lags + 5} THEN mean END AS mean, CASE WHEN n>={lags + 5} THEN se END AS se, CASE WHEN n>={lags + 5} AND se>0 THEN mean/se END AS t FROM {name}s)"""


def daily(spark, sf):
    return st.decile_spread(scored(spark, sf), SP)


@query("decile_spread", f"WITH {DECS} SELECT session_no, date, formed, round(spread, 8)+0.0 AS spread FROM dsp WHERE part='full'")
def _(spark, sf):
    return daily(spark, sf).select("session_no", "date", "formed", fixed(F.col("spread"), 8).alias("spread"))


@query("newey_west", f"WITH {DECS}, {nw_sql('dsp', 'spread', LAGS)} SELECT n, round(mean, 8) AS mean, round(se, 8) AS se, round(t, 6) AS t FROM nw WHERE part='full'")
def _(spark, sf):
    return st.newey_west(daily(spark, sf), "spread", LAGS).select("n", fixed(F.col("mean"), 8).alias("mean"), fixed(F.col("se"), 8).alias("se"), fixed(F.col("t")).alias("t"))


SUM = f"""{nw_sql('dsp', 'spread', LAGS)}, sm AS (SELECT part, n, mean, se, t, 5200.0*mean AS annual_pct, 5200.0*mean-1.96*5200.0*se AS ci_low, 5200.0*mean+1.96*5200.0*se AS ci_high, years, rebalances
 FROM nw JOIN (SELECT part, (max(date)-min(date))/365.25 AS years, count(DISTINCT formed) AS rebalances FROM dsp GROUP BY 1) USING (part))"""
_SC = ("t", "annual_pct", "ci_low", "ci_high", "years")


@query("spread_summary", f"WITH {DECS}, {SUM} SELECT n, rebalances, {', '.join(f'round({c}, 5) AS {c}' for c in _SC)} FROM sm WHERE part='full'")
def _(spark, sf):
    return st.spread_summary(daily(spark, sf), LAGS, per_year=YEAR).select("n", "rebalances", *[fixed(F.col(c), 5).alias(c) for c in _SC])


FM = REB + """, fr AS (SELECT e.session_no, e.date, e.symbol, e.score, f.close/e.close-1 AS fwd FROM elig e JOIN panel f ON f.symbol=e.symbol AND f.session_no=e.session_no+4
 WHERE eligible AND score IS NOT NULL AND e.session_no>=54 AND (e.session_no-54)%4=0),
fk AS (SELECT *, (row_number() OVER (PARTITION BY session_no ORDER BY score, symbol)-1)/greatest(count(*) OVER (PARTITION BY session_no)-1, 1) AS x FROM fr),
fs AS (SELECT 'full' AS part, session_no, date, regr_slope(fwd, x) AS slope, count(*) AS width FROM fk GROUP BY ALL HAVING count(*)>=20)"""


@query("fama_macbeth_slopes", f"WITH {FM} SELECT session_no, date, round(slope, 8)+0.0 AS slope, width FROM fs")
def _(spark, sf):
    return st.fama_macbeth_slopes(scored(spark, sf), SP, 20).select("session_no", "date", fixed(F.col("slope"), 8).alias("slope"), "width")


@query("fama_macbeth", f"WITH {FM}, {nw_sql('fs', 'slope', 3)} SELECT n, round(mean, 8) AS mean, round(se, 8) AS se, round(t, 6) AS t, (SELECT count(*) FROM fs) AS periods, (SELECT round(avg(width), 6) FROM fs) AS avg_names FROM nw")
def _(spark, sf):
    f = st.fama_macbeth(st.fama_macbeth_slopes(scored(spark, sf), SP, 20))
    return f.select("n", fixed(F.col("mean"), 8).alias("mean"), fixed(F.col("se"), 8).alias("se"), fixed(F.col("t")).alias("t"), "periods", fixed(F.col("avg_names")).alias("avg_names"))


VERD = f"""{SUM}, {nw_sql('fs', 'slope', 3, name='fw')}, one AS (SELECT max(mean) FILTER (WHERE part='full') AS mean, max(t) FILTER (WHERE part='full') AS t, max(years) FILTER (WHERE part='full') AS years,
 max(annual_pct) FILTER (WHERE part='full') AS annual_pct, max(mean) FILTER (WHERE part='first') AS first_mean, max(mean) FILTER (WHERE part='second') AS second_mean FROM sm)
SELECT round(one.mean, 8) AS mean, round(one.t, 6) AS t, round(years, 6) AS years, round(annual_pct, 5) AS annual_pct, round(first_mean, 8) AS first_mean, round(second_mean, 8) AS second_mean, round(fw.mean, 8) AS fm_mean, round(fw.t, 6) AS fm_t,
CASE WHEN one.t IS NULL THEN 'INCONCLUSIVE' WHEN one.t<=-2 OR one.mean<0 THEN 'FAIL' WHEN one.t<2 THEN 'INCONCLUSIVE' WHEN NOT (first_mean>0 AND second_mean>0) THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict, years<15 AS pilot FROM one, fw"""
_FMTAIL = FM.split("rt AS ")[1].split(", fr AS ")[1]


def _verdict(spark, sf, data):
    n = data.agg(F.max("session_no")).first()[0]
    v = st.stage1_verdict(data, SP, LAGS, n, 20, YEAR)
    return v.select(fixed(F.col("mean"), 8).alias("mean"), fixed(F.col("t")).alias("t"), fixed(F.col("years")).alias("years"), fixed(F.col("annual_pct"), 5).alias("annual_pct"),
                    fixed(F.col("first_mean"), 8).alias("first_mean"), fixed(F.col("second_mean"), 8).alias("second_mean"), fixed(F.col("fm_mean"), 8).alias("fm_mean"), fixed(F.col("fm_t")).alias("fm_t"), "verdict", "pilot")


@query("stage1_verdict", f"WITH {DECS}, fr AS {_FMTAIL}, {VERD}")
def _(spark, sf):
    return _verdict(spark, sf, scored(spark, sf))


LISTED = ", el2 AS (SELECT symbol, session_no, score, eligible AND date - min(date) OVER (PARTITION BY symbol) >= 728 AS eligible FROM elig)"


@query("listing_age_subtest", f"WITH {REB}{LISTED}, {DEC[len(REB) + 2:].replace('{elig}', 'el2')}, {SUM} SELECT n, rebalances, {', '.join(f'round({c}, 5) AS {c}' for c in _SC)} FROM sm WHERE part='full'")
def _(spark, sf):
    s = st.decile_spread(st.listing_age_filter(scored(spark, sf), 728), SP)
    return st.spread_summary(s, LAGS, per_year=YEAR).select("n", "rebalances", *[fixed(F.col(c), 5).alias(c) for c in _SC])


EW = CURVE + """, ewr AS (SELECT rt.session_no, rt.date, avg(ret) AS ret FROM rt GROUP BY ALL), ew AS (SELECT *, exp(sum(ln(1+coalesce(ret, 0))) OVER (ORDER BY session_no)) AS value FROM ewr),
al AS (SELECT date, a.curve/lag(a.curve) OVER (ORDER BY date)-1 AS rs, b.value/lag(b.value) OVER (ORDER BY date)-1 AS rb FROM crv a JOIN ew b USING (date)),
al2 AS (SELECT * FROM al WHERE rs IS NOT NULL AND rb IS NOT NULL),
ab0 AS (SELECT regr_slope(rs, rb) AS beta, regr_intercept(rs, rb) AS alpha, corr(rs, rb) AS c, regr_syy(rs, rb) AS syy, regr_sxx(rs, rb) AS sxx, regr_sxy(rs, rb) AS sxy, count(*) AS n FROM al2),
ab AS (SELECT n AS observations, beta, 5200.0*alpha AS alpha_annual_pct, alpha/(sqrt((syy-beta*sxy)/(n-2))/sqrt(n)) AS t_alpha, (beta-1)/(sqrt((syy-beta*sxy)/(n-2))/(sqrt(sxx/(n-1))*sqrt(n))) AS t_beta_vs_one, c AS correlation FROM ab0)"""


def strategy(spark, sf):
    return xs.holdings_return_curve(scored(spark, sf), 10, 4, 14.6).select("session_no", "date", F.col("curve").alias("value"))


def bench(spark, sf):
    return st.equal_weight_curve(src.panel(spark, sf)).select("session_no", "date", "value")


@query("equal_weight_curve", f"WITH {EW} SELECT session_no, date, round(ret, 8)+0.0 AS ret, round(value, 6) AS value FROM ew")
def _(spark, sf):
    return st.equal_weight_curve(src.panel(spark, sf)).select("session_no", "date", fixed(F.col("ret"), 8).alias("ret"), fixed(F.col("value")).alias("value"))


@query("equal_weight_eligible", f"""WITH {EW}, er AS (SELECT e.session_no, e.date, avg(ret) FILTER (WHERE eligible) AS ret FROM elig e JOIN rt USING (symbol, session_no) GROUP BY ALL)
SELECT session_no, er.date, round(sum(ln(1+coalesce(ret, 0))) OVER (ORDER BY session_no), 8)+0.0 AS log_value FROM er""")
def _(spark, sf):
    return st.equal_weight_curve(scored(spark, sf), True).select("session_no", "date", fixed(F.log("value"), 8).alias("log_value"))


@query("series_align", f"WITH {EW} SELECT date, round(rs, 8)+0.0 AS rs, round(rb, 8)+0.0 AS rb FROM al2")
def _(spark, sf):
    a = st.series_align(strategy(spark, sf), bench(spark, sf))
    return a.select("date", fixed(F.col("rs"), 8).alias("rs"), fixed(F.col("rb"), 8).alias("rb"))


_AB = ("beta", "alpha_annual_pct", "t_alpha", "t_beta_vs_one", "correlation")


@query("alpha_beta", f"WITH {EW} SELECT observations, {', '.join(f'round({c}, 6) AS {c}' for c in _AB)} FROM ab")
def _(spark, sf):
    a = st.alpha_beta(st.series_align(strategy(spark, sf), bench(spark, sf)), per_year=YEAR)
    return a.select("observations", *[fixed(F.col(c)).alias(c) for c in _AB])


@query("beta_matched", f"""WITH {EW}, br AS (SELECT session_no, date, coalesce(value/lag(value) OVER (ORDER BY session_no)-1, 0) AS r FROM ew)
SELECT session_no, date, round(exp(sum(ln(1+(SELECT beta FROM ab)*r)) OVER (ORDER BY session_no)), 6) AS value FROM br""")
def _(spark, sf):
    beta = st.alpha_beta(st.series_align(strategy(spark, sf), bench(spark, sf)), per_year=YEAR).select("beta")
    return st.beta_matched(bench(spark, sf), beta.scalar()).withColumn("value", fixed(F.col("value")))


@query("benchmark_reindex", f"""WITH {EW}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT d.date, round(e.value, 6) AS value FROM d LEFT JOIN ew e USING (date) WHERE false UNION ALL
SELECT date, round(last_value(value IGNORE NULLS) OVER (ORDER BY date), 6) AS value FROM (SELECT d.date, value FROM d LEFT JOIN ew USING (date))""")
def _(spark, sf):
    d = src.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return st.benchmark_reindex(d, bench(spark, sf)).withColumn("value", fixed(F.col("value")))


LEGS = EW + """, lv AS (SELECT 'strategy' AS series_id, date, curve AS value FROM crv UNION ALL SELECT 'benchmark', date, value FROM ew),
lr AS (SELECT *, value/lag(value) OVER (PARTITION BY series_id ORDER BY date)-1 AS r, value/max(value) OVER (PARTITION BY series_id ORDER BY date)-1 AS dd FROM lv),
ls AS (SELECT series_id, 100*(max_by(value, date)/min_by(value, date)-1) AS total_pct, 100*(power(max_by(value, date)/min_by(value, date), 1/((max(date)-min(date))/365.25))-1) AS cagr_pct,
 avg(r)/stddev_samp(r)*sqrt(52) AS sharpe, 100*min(dd) AS max_drawdown_pct, max_by(value, date) AS final_value FROM lr GROUP BY 1)"""
_LC = ("total_pct", "cagr_pct", "sharpe", "max_drawdown_pct", "final_value")


def legs(spark, sf):
    both = strategy(spark, sf).withColumn("series_id", F.lit("strategy")).unionByName(bench(spark, sf).withColumn("series_id", F.lit("benchmark")))
    return st.leg_stats(both.select("series_id", "date", "value"), per_year=YEAR)


@query("leg_stats", f"WITH {LEGS} SELECT series_id, {', '.join(f'round({c}, 5) AS {c}' for c in _LC)} FROM ls")
def _(spark, sf):
    return legs(spark, sf).select("series_id", *[fixed(F.col(c), 5).alias(c) for c in _LC])


@query("sharpe_bar", f"""WITH {LEGS} SELECT round(max(sharpe) FILTER (WHERE series_id='strategy'), 6) AS strategy_sharpe, round(max(sharpe) FILTER (WHERE series_id='benchmark'), 6) AS benchmark_sharpe,
CASE WHEN max(sharpe) FILTER (WHERE series_id='strategy') > max(sharpe) FILTER (WHERE series_id='benchmark') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ls""")
def _(spark, sf):
    b = st.sharpe_bar(legs(spark, sf), "strategy", "benchmark")
    return b.select(fixed(F.col("strategy_sharpe")).alias("strategy_sharpe"), fixed(F.col("benchmark_sharpe")).alias("benchmark_sharpe"), "verdict")


@query("yearly_returns", f"""WITH {EW}, y AS (SELECT year(a.date) AS year, 100*(max_by(curve, a.date)/min_by(curve, a.date)-1) AS s, 100*(max_by(value, a.date) FILTER (WHERE value IS NOT NULL)/min_by(value, a.date) FILTER (WHERE value IS NOT NULL)-1) AS b,
 count(*) AS n, count(value) AS m FROM crv a LEFT JOIN ew b USING (date) GROUP BY 1)
SELECT year, round(s, 5) AS strategy_pct, round(b, 5) AS benchmark_pct, round(s-b, 5) AS excess_pp FROM y WHERE n>=2 AND m>=2""")
def _(spark, sf):
    c = strategy(spark, sf).select("date", F.col("value").alias("strategy")).join(bench(spark, sf).select("date", F.col("value").alias("benchmark")), "date", "left")
    return st.yearly_returns(c).select("year", *[fixed(F.col(x), 5).alias(x) for x in ("strategy_pct", "benchmark_pct", "excess_pp")])


COST = 14.6
NULL = CURVE + """, el AS (SELECT rebalance_no, e.session_no, symbol, row_number() OVER (PARTITION BY e.session_no ORDER BY symbol) AS place, count(*) OVER (PARTITION BY e.session_no) AS size
 FROM elig e JOIN reb USING (session_no) WHERE eligible AND score IS NOT NULL AND isfinite(score)), sz AS (SELECT DISTINCT rebalance_no, session_no, size FROM el),
dk AS (SELECT trial, rebalance_no, session_no, size, k, CAST('0x' || substr(md5(concat_ws('|', trial, session_no, k)), 1, 8) AS BIGINT) AS h
 FROM sz, range(200) a(trial), range(40) b(k) WHERE k < size),
dp AS (SELECT trial, rebalance_no, session_no, CASE WHEN size<=40 THEN k ELSE h%size END + 1 AS place, min(CASE WHEN size<=40 THEN h ELSE k END) AS o FROM dk GROUP BY ALL),
tt AS (SELECT trial, dp.rebalance_no, dp.session_no, symbol FROM dp JOIN el USING (session_no, place) QUALIFY row_number() OVER (PARTITION BY trial, dp.session_no ORDER BY o, place)<=10),
nd AS (SELECT trial, r.session_no, avg(ret) AS gross FROM tt t JOIN rt r ON r.symbol=t.symbol AND r.session_no BETWEEN t.session_no+1 AND t.session_no+4 GROUP BY ALL),
nc AS (SELECT coalesce(a.trial, b.trial) AS trial, coalesce(a.rebalance_no, b.rebalance_no+1) AS rebalance_no, count(*) FILTER (WHERE a.symbol IS NULL OR b.symbol IS NULL)/10 AS traded
 FROM tt a FULL JOIN tt b ON a.trial=b.trial AND a.symbol=b.symbol AND a.rebalance_no=b.rebalance_no+1 GROUP BY ALL),
nw2 AS (SELECT trial, session_no+1 AS session_no, traded FROM nc JOIN reb USING (rebalance_no)),
nul AS (SELECT trial, 100*(exp(sum(ln(1+coalesce(gross, 0)-coalesce(traded, 0)*14.6/1e4)))-1) AS total_pct FROM nd LEFT JOIN nw2 USING (trial, session_no) GROUP BY 1),
own AS (SELECT 100*(exp(sum(ln(1+net)))-1) AS total_pct FROM nt)"""


def null(spark, sf):
    return st.random_null(scored(spark, sf), 10, 4, 200, COST)


@query("random_null", f"WITH {NULL} SELECT CAST(trial AS BIGINT) AS trial, round(total_pct, 5) AS total_pct FROM nul")
def _(spark, sf):
    return null(spark, sf).select(F.col("trial").cast("long").alias("trial"), fixed(F.col("total_pct"), 5).alias("total_pct"))


_PS = (0.05, 0.25, 0.50, 0.75, 0.95)


@query("null_quantiles", f"WITH {NULL} SELECT {', '.join(f'round(quantile_cont(total_pct, {p}), 5) AS p{round(100 * p)}' for p in _PS)} FROM nul")
def _(spark, sf):
    d = st.null_quantiles(null(spark, sf), "total_pct", _PS)
    return d.select(*[fixed(F.col(c), 5).alias(c) for c in d.columns])


@query("percentile_of", f"WITH {NULL} SELECT round(100.0*avg(CAST(round(total_pct, 9) < (SELECT round(total_pct, 9) FROM own) AS INT)), 6) AS percentile FROM nul")
def _(spark, sf):
    """The strategy's place among the random selections of the same engine."""
    rows = settle(scored(spark, sf), "symbol", "date", "session_no", "close", "score", "eligible")
    own = st.strategy_return(rows, 10, 4, COST).select("total_pct")
    return st.percentile_of(st.random_null(rows, 10, 4, 200, COST), "total_pct", own.scalar()).withColumn("percentile", fixed(F.col("percentile")))


@query("buy_and_hold", f"""WITH {q.WBARS} SELECT symbol, date, round(CASE WHEN date=max(date) OVER (PARTITION BY symbol) THEN v*(1-0.0005) ELSE v END, 5) AS value
FROM (SELECT symbol, date, 40000*(1-0.001)*close/first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS v FROM wbars)""")
def _(spark, sf):
    b = st.buy_and_hold(src.weekly_bars(spark, sf), 40000.0, 0.001, 0.0005)
    return b.withColumn("value", fixed(F.col("value"), 5))


@query("equal_weight_hold", f"""WITH {q.PANEL}, gr AS (SELECT s.symbol, c.date, c.session_no, s.p0 FROM (SELECT symbol, close AS p0 FROM panel WHERE session_no=1 AND close>0) s CROSS JOIN cal c),
nv AS (SELECT g.symbol, g.date, g.session_no, last_value(p.close/p0 IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.session_no) AS v FROM gr g LEFT JOIN panel p USING (symbol, session_no)),
bk AS (SELECT session_no, date, 40000*(1-0.001)*avg(v) AS value, count(v) AS names FROM nv GROUP BY ALL)
SELECT session_no, date, names, round(CASE WHEN session_no=max(session_no) OVER () THEN value*(1-0.0005) ELSE value END, 5) AS value FROM bk""")
def _(spark, sf):
    h = st.equal_weight_hold(cal.align_calendar(src.panel(spark, sf)), 40000.0, 0.001, 0.0005)
    return h.withColumn("value", fixed(F.col("value"), 5))


SIDES = (3, 5, 10)


@query("power_table", f"""WITH {REB}, nx AS (SELECT e.*, f.close/e.close-1 AS nxt FROM elig e LEFT JOIN panel f ON f.symbol=e.symbol AND f.session_no=e.session_no+1 WHERE eligible AND e.score IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score DESC, symbol) AS a, row_number() OVER (PARTITION BY session_no ORDER BY score, symbol) AS b, count(*) OVER (PARTITION BY session_no) AS width FROM nx),
dy AS (SELECT n AS n_side, session_no, avg(nxt) FILTER (WHERE a<=n)-avg(nxt) FILTER (WHERE b<=n) AS s, max(width) AS width, count(nxt) FILTER (WHERE a<=n) AS l, count(nxt) FILTER (WHERE b<=n) AS h
 FROM rk, (VALUES (3),(5),(10)) t(n) WHERE width>=4*n GROUP BY ALL),
pw AS (SELECT n_side, count(*) AS observations, avg(width) AS avg_names, stddev_samp(s)*sqrt(52)*100 AS vol, count(*)/52 AS years FROM dy WHERE s IS NOT NULL AND l>=n_side//2 AND h>=n_side//2 GROUP BY 1)
SELECT n_side, observations, round(avg_names, 6) AS avg_names, round(vol, 5) AS vol_pct, round(vol/sqrt(years), 5) AS se_pct, round(2*vol/sqrt(years), 5) AS detectable_pct, round(power(vol/2.5, 2), 4) AS years_for_5pct FROM pw""")
def _(spark, sf):
    p = st.power_table(scored(spark, sf), SIDES, YEAR)
    return p.select("n_side", "observations", fixed(F.col("avg_names")).alias("avg_names"), *[fixed(F.col(c), 5).alias(c) for c in ("vol_pct", "se_pct", "detectable_pct")], fixed(F.col("years_for_5pct"), 4).alias("years_for_5pct"))


BREADTH = """, bm AS (SELECT symbol, session_no, CASE WHEN count(*) OVER w>=10 THEN CAST(close>avg(close) OVER w AS INT) END AS above FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY session_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
bg AS (SELECT symbol, date, session_no FROM (SELECT DISTINCT symbol FROM panel) CROSS JOIN cal),
bf AS (SELECT date, session_no, last_value(above IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session_no) AS above FROM bg LEFT JOIN bm USING (symbol, session_no)),
br AS (SELECT date, session_no, avg(above) AS breadth, count(above) AS names FROM bf WHERE above IS NOT NULL GROUP BY ALL)"""


@query("breadth", f"WITH {q.PANEL}{BREADTH} SELECT date, session_no, round(breadth, 8) AS breadth, names FROM br")
def _(spark, sf):
    return st.breadth(src.panel(spark, sf), 10).withColumn("breadth", fixed(F.col("breadth"), 8))


@query("cross_section_per_day", f"WITH {q.WBARS} SELECT date, count(close) AS names FROM wbars GROUP BY 1")
def _(spark, sf):
    return st.cross_section_per_day(src.weekly_bars(spark, sf))


@query("evaluator_hook", f"WITH {CURVE} SELECT 0 AS trial, round(100*(max_by(curve, session_no)-1), 4) AS total_pct FROM crv")
def _(spark, sf):
    """The evaluator of the random trials run with the strategy's own targets: the last value of its curve."""
    return st.strategy_return(scored(spark, sf), 10, 4, COST).withColumn("total_pct", fixed(F.col("total_pct"), 4))
