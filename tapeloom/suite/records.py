"""Trade-record analytics and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import beside, fixed
from tapeloom.operators import digests as dg
from tapeloom.operators import records as rc
from tapeloom.session import settle
from tapeloom.sources import archive
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.register import query

LIMITS = rc.LimitParams(loss_limit=200.0, profit_lock=300.0, max_losses=3, max_trades=8)
CAPITAL = 2_000_000.0
NET = q.TRADES + ", net AS (SELECT *, gross_pnl-costs AS net_pnl FROM trades)"


def trades(spark, sf):
    return rc.net_trades(src.trades(spark, sf))


def rounded(df, keep, cols, digits=6):
    return df.select(*keep, *[fixed(F.col(c), digits).alias(c) for c in cols])


def _breakeven(key, loss, flag):
    @query(key, f"""WITH {NET}, g AS (SELECT coalesce(strategy, 'ALL') AS strategy, count(*) AS trades, sum(net_pnl) AS net, avg(net_pnl) FILTER (WHERE net_pnl>0) AS avg_win, abs(avg(net_pnl) FILTER (WHERE {loss})) AS avg_loss,
     avg(CAST(net_pnl>0 AS INT)) AS actual FROM net GROUP BY ROLLUP(strategy))
    SELECT strategy, trades, round(net, 4) AS net, round(avg_win/avg_loss, 6) AS payoff, round(1/(1+avg_win/avg_loss), 8) AS needed, round(actual, 8) AS actual, round(actual-1/(1+avg_win/avg_loss), 8) AS gap FROM g""")
    def _(spark, sf):
        b = rc.breakeven_diagnosis(trades(spark, sf), flag)
        return b.select("strategy", "trades", fixed(F.col("net"), 4).alias("net"), fixed(F.col("payoff")).alias("payoff"), *[fixed(F.col(c), 8).alias(c) for c in ("needed", "actual", "gap")])


_breakeven("breakeven_diagnosis", "net_pnl<=0", True)
_breakeven("breakeven_strict_loss", "net_pnl<0", False)


@query("exit_mix", f"WITH {NET} SELECT strategy, reason, count(*) AS trades, round(avg(net_pnl), 7) AS mean, round(sum(net_pnl), 5) AS net, round(100*avg(CAST(net_pnl>0 AS INT)), 6) AS win_rate_pct FROM net GROUP BY ALL")
def _(spark, sf):
    m = rc.exit_mix(trades(spark, sf))
    return m.select("strategy", "reason", "trades", fixed(F.col("mean"), 7).alias("mean"), fixed(F.col("net"), 5).alias("net"), fixed(F.col("win_rate_pct")).alias("win_rate_pct"))


@query("cost_drag", f"WITH {NET} SELECT round(avg(costs), 8) AS mean_cost, round(avg(quantity*entry_price), 5) AS mean_notional, round(avg(costs)/avg(quantity*entry_price)*1e4, 8) AS cost_bps, round(sum(costs)/sum(abs(gross_pnl)), 8) AS cost_share FROM net")
def _(spark, sf):
    c = rc.cost_drag(trades(spark, sf))
    return c.select(fixed(F.col("mean_cost"), 8).alias("mean_cost"), fixed(F.col("mean_notional"), 5).alias("mean_notional"), fixed(F.col("cost_bps"), 8).alias("cost_bps"), fixed(F.col("cost_share"), 8).alias("cost_share"))


AUD = NET + """, ro AS (SELECT *, sum(net_pnl) OVER s AS rnet, sum(CAST(net_pnl>=0 AS INT)) OVER s AS island, row_number() OVER s AS rn FROM net WINDOW s AS (PARTITION BY trade_date ORDER BY close_min, trade_id ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, sum(CAST(net_pnl<0 AS INT)) OVER (PARTITION BY trade_date, island ORDER BY rn) AS streak FROM ro),
hk AS (SELECT *, CASE WHEN rnet<=-200 THEN 'loss_limit' WHEN rnet>=300 THEN 'profit_lock' WHEN streak>=3 THEN 'consecutive_losses' END AS kind FROM st),
hp AS (SELECT trade_date, count(*) AS trades, max(streak) AS longest_losing_streak, greatest(count(*)-8, 0) AS beyond_cap, min_by(close_min, rn) FILTER (WHERE kind IS NOT NULL) AS halt_min, min_by(kind, rn) FILTER (WHERE kind IS NOT NULL) AS halt_kind FROM hk GROUP BY 1),
oa AS (SELECT t.trade_date, count(*) AS n FROM net t JOIN hp USING (trade_date) WHERE open_min>halt_min GROUP BY 1),
aud AS (SELECT hp.*, coalesce(n, 0) AS opened_after_halt FROM hp LEFT JOIN oa USING (trade_date))"""


@query("session_limit_audit", f"WITH {AUD} SELECT trade_date, trades, CAST(longest_losing_streak AS BIGINT) AS longest_losing_streak, beyond_cap, halt_min, halt_kind, opened_after_halt FROM aud")
def _(spark, sf):
    return rc.session_limit_audit(trades(spark, sf), LIMITS)


SESS = AUD + """, ses AS (SELECT n.trade_date, ['bull_trend','neutral_range','bear_volatile'][1+month(n.trade_date)%3] AS regime, count(DISTINCT symbol) AS universe_size, count(*) AS trades, count(*) FILTER (WHERE net_pnl>0) AS wins, sum(gross_pnl) AS gross_pnl, sum(costs) AS costs, sum(net_pnl) AS net_pnl,
 count(*)+count(*) FILTER (WHERE reason='squareoff') AS signals, count(*) AS entries, count(*) FILTER (WHERE reason='squareoff') AS rejected_by_risk, any_value(halt_kind) AS halt_kind,
 sum(quantity*entry_price*5.0/1e4) AS modelled_slippage, sum(quantity*entry_price*(symbol%7)/1e4) AS observed_slippage FROM net n JOIN (SELECT trade_date, halt_kind FROM aud) USING (trade_date) GROUP BY n.trade_date)"""


def sessions(spark, sf):
    """The session record of the trade fixture; squared-off trades double as risk-rejected signals."""
    t = trades(spark, sf)
    regime = F.element_at(F.array(F.lit("bull_trend"), F.lit("neutral_range"), F.lit("bear_volatile")), 1 + F.month("trade_date") % 3)
    ctx = t.groupBy("trade_date").agg(F.countDistinct("symbol").alias("universe_size")).withColumn("regime", regime)
    sig = t.select("trade_date", F.lit("entered").alias("outcome")).unionByName(
        t.filter(F.col("reason") == "squareoff").select("trade_date", F.lit("rejected").alias("outcome")))
    halts = rc.session_limit_audit(t, LIMITS).filter("halt_kind IS NOT NULL").select("trade_date", "halt_kind", F.concat(F.lit("halt: "), "halt_kind").alias("halt_reason"))
    notional = F.col("quantity") * F.col("entry_price")
    slip = t.groupBy("trade_date").agg(F.sum(notional * 5.0 / 1e4).alias("modelled_slippage"), F.sum(notional * (F.col("symbol") % 7) / 1e4).alias("observed_slippage"),
                                       F.lit("market").alias("slippage_source"))
    return rc.session_record(t, sig, ctx, halts, 250.0, slip)


@query("session_record", f"""WITH {SESS} SELECT trade_date, regime, universe_size, trades, wins, round(gross_pnl, 9)+0.0 AS gross_pnl, round(costs, 9) AS costs, round(net_pnl, 9)+0.0 AS net_pnl, signals, entries, rejected_by_risk, halt_kind IS NOT NULL AS halted,
 'halt: ' || halt_kind AS halt_reason, halt_kind, round(modelled_slippage, 9) AS modelled_slippage, round(observed_slippage, 9) AS observed_slippage, 'simulated' AS fill_source, 'market' AS slippage_source, CAST(250.0 AS DOUBLE) AS loss_limit FROM ses""")
def _(spark, sf):
    s = sessions(spark, sf)
    return s.withColumns({c: fixed(F.col(c), 9) for c in ("gross_pnl", "costs", "net_pnl", "modelled_slippage", "observed_slippage")})


@query("regime_attribution", f"WITH {SESS} SELECT regime, count(*) AS sessions, round(sum(net_pnl), 5) AS net, round(avg(net_pnl), 7) AS mean, CAST(sum(trades) AS BIGINT) AS trades FROM ses GROUP BY 1")
def _(spark, sf):
    r = rc.regime_attribution(sessions(spark, sf))
    return r.select("regime", "sessions", fixed(F.col("net"), 5).alias("net"), fixed(F.col("mean"), 7).alias("mean"), "trades")


@query("halt_counts", f"WITH {SESS} SELECT halt_kind, count(*) AS sessions, round(count(*)/(SELECT count(*) FROM ses), 8) AS share FROM ses WHERE halt_kind IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return rc.halt_counts(sessions(spark, sf)).withColumn("share", fixed(F.col("share"), 8))


@query("replay_summary", f"""WITH {SESS} SELECT count(*) AS sessions, CAST(sum(trades) AS BIGINT) AS trades, round(sum(wins)/sum(trades), 8) AS win_rate, round(sum(gross_pnl), 4) AS gross, round(sum(costs), 4) AS costs, round(sum(net_pnl), 4) AS net, round(max(net_pnl), 6) AS best, round(min(net_pnl), 6) AS worst,
 round(sum(net_pnl) FILTER (WHERE net_pnl>0)/abs(sum(net_pnl) FILTER (WHERE net_pnl<0)), 8) AS profit_factor, count(*) FILTER (WHERE net_pnl < -250) AS breaches, count(*) FILTER (WHERE halt_kind IS NOT NULL) AS halted FROM ses""")
def _(spark, sf):
    r = rc.replay_summary(sessions(spark, sf))
    return r.withColumns({**{c: fixed(F.col(c), 4) for c in ("gross", "costs", "net")}, **{c: fixed(F.col(c)) for c in ("best", "worst")}, **{c: fixed(F.col(c), 8) for c in ("win_rate", "profit_factor")}})


SCORE = SESS + """, sa AS (SELECT count(*) AS n, sum(trades) AS tr, sum(net_pnl) AS net, sum(net_pnl) FILTER (WHERE net_pnl>0)/abs(sum(net_pnl) FILTER (WHERE net_pnl<0)) AS pf, sum(observed_slippage)/sum(modelled_slippage) AS ratio, count(*) FILTER (WHERE net_pnl < -250) AS breach, DATE '2001-09-01'-max(trade_date) AS age FROM ses),
score AS (SELECT 'sessions' AS "check", n>=20 AS ok, CAST(n AS DOUBLE) AS value FROM sa UNION ALL SELECT 'trades', tr>=40, CAST(tr AS DOUBLE) FROM sa UNION ALL SELECT 'net_profitability', net>0, net FROM sa UNION ALL SELECT 'profit_factor', pf>=1.2, pf FROM sa
 UNION ALL SELECT 'slippage_fidelity', ratio<=1.5, ratio FROM sa UNION ALL SELECT 'daily_limit_respected', breach=0, breach FROM sa UNION ALL SELECT 'freshness', age<=14, age FROM sa)"""


def scorecard(spark, sf):
    return rc.evidence_scorecard(sessions(spark, sf), "2001-09-01")


@query("evidence_scorecard", f'WITH {SCORE} SELECT "check", ok, round(value, 5) AS value FROM score')
def _(spark, sf):
    return scorecard(spark, sf).withColumn("value", fixed(F.col("value"), 5))


@query("waiver_apply", f"""WITH {SCORE}, wv AS (SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'net_profitability' WHEN '2-HIGH' THEN 'daily_limit_respected' WHEN '3-MEDIUM' THEN 'profit_factor' ELSE 'sessions' END AS "check", CASE WHEN o_orderpriority='3-MEDIUM' THEN ' ' ELSE 'accepted' END AS r FROM orders)
SELECT "check", CASE WHEN ok THEN 'PASS' WHEN r IS NULL THEN 'FAIL' WHEN "check" NOT IN ('net_profitability','profit_factor','sessions','trades') OR trim(r)='' THEN 'REFUSED' ELSE 'WAIVED' END AS status FROM score LEFT JOIN wv USING ("check")""")
def _(spark, sf):
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "net_profitability").when(p == "2-HIGH", "daily_limit_respected").when(p == "3-MEDIUM", "profit_factor").otherwise("sessions")
    wv = src.table(spark, sf, "orders").select(name.alias("check"), F.when(p == "3-MEDIUM", " ").otherwise("accepted").alias("waiver_reason"))
    return rc.waiver_apply(scorecard(spark, sf), wv).select("check", "status")


@query("peak_drawdown_limit", f"""WITH {SESS}, e AS (SELECT trade_date, sum(net_pnl) OVER s AS equity, avg(net_pnl) OVER s AS rate FROM ses WINDOW s AS (ORDER BY trade_date)), p AS (SELECT *, greatest(max(equity) OVER (ORDER BY trade_date), 0) AS peak FROM e)
SELECT trade_date, round(equity, 2)+0.0 AS equity, round(peak, 2) AS peak, round(peak-equity, 2)+0.0 AS drawdown, peak-equity>=200000 AS tripped, round(CASE WHEN peak-equity<200000 THEN 200000-(peak-equity) END, 2) AS room,
CAST(CASE WHEN peak-equity<200000 AND rate<0 THEN floor((200000-(peak-equity))/abs(rate)) END AS BIGINT) AS sessions_left FROM p""")
def _(spark, sf):
    p = rc.peak_drawdown_limit(sessions(spark, sf), CAPITAL, 10.0)
    return p.withColumns({c: fixed(F.col(c), 2) for c in ("equity", "peak", "drawdown", "room")})


@query("open_exposure", f"""WITH {NET}, ev AS (SELECT trade_date, open_min AS minute, 1 AS d, quantity*entry_price AS v FROM net UNION ALL SELECT trade_date, close_min, -1, quantity*entry_price FROM net), g AS (SELECT trade_date, minute, sum(d) AS p, sum(d*v) AS v FROM ev GROUP BY ALL)
SELECT trade_date, minute, CAST(sum(p) OVER s AS BIGINT) AS open_positions, round(sum(v) OVER s, 6)+0.0 AS gross_exposure, round(sum(v*0.01) OVER s, 6)+0.0 AS open_risk FROM g WINDOW s AS (PARTITION BY trade_date ORDER BY minute)""")
def _(spark, sf):
    return rc.open_exposure(trades(spark, sf)).withColumns({c: fixed(F.col(c), 6) for c in ("gross_exposure", "open_risk")})


@query("session_vs_prior", f"""WITH {SESS}, cl AS (SELECT CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS trade_date FROM ses),
p AS (SELECT trade_date, net_pnl, avg(net_pnl) OVER s AS pm, count(net_pnl) OVER s AS n FROM ses WINDOW s AS (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trade_date, round(net_pnl, 9)+0.0 AS net_pnl, round(pm, 5)+0.0 AS prior_mean, n AS prior_sessions, CASE WHEN net_pnl IS NULL THEN 'none' WHEN net_pnl < -250 THEN 'breached' ELSE 'held' END AS status FROM cl LEFT JOIN p USING (trade_date) WHERE isodow(trade_date)<=5""")
def _(spark, sf):
    s = sessions(spark, sf)
    days = archive.weekday_calendar(s.agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))).withColumnRenamed("date", "trade_date")
    return rc.session_vs_prior(s, days).withColumns({"net_pnl": fixed(F.col("net_pnl"), 9), "prior_mean": fixed(F.col("prior_mean"), 5)})


EQ = SESS + ", eqc AS (SELECT trade_date, 2000000+sum(net_pnl) OVER (ORDER BY trade_date) AS equity FROM ses)"


@query("yearly_trades", f"""WITH {EQ}, y AS (SELECT year(trade_date) AS year, count(*) AS trades, sum(gross_pnl) AS gross, sum(costs) AS costs, sum(net_pnl) AS net, 100*avg(CAST(net_pnl>0 AS INT)) AS wr FROM net GROUP BY 1), ye AS (SELECT year(trade_date) AS year, max_by(equity, trade_date) AS equity_end FROM eqc GROUP BY 1)
SELECT year, trades, round(gross, 4) AS gross, round(costs, 4) AS costs, round(net, 4) AS net, round(wr, 6) AS win_rate_pct, round(equity_end, 4) AS equity_end FROM y JOIN ye USING (year)""")
def _(spark, sf):
    y = rc.yearly_trades(trades(spark, sf), rc.equity_curve(sessions(spark, sf), CAPITAL))
    return y.withColumns({**{c: fixed(F.col(c), 4) for c in ("gross", "costs", "net", "equity_end")}, "win_rate_pct": fixed(F.col("win_rate_pct"))})


@query("swing_summary", f"""WITH {EQ}, cr AS (SELECT trade_date, equity, equity/lag(equity) OVER (ORDER BY trade_date)-1 AS r, equity/max(equity) OVER (ORDER BY trade_date)-1 AS dd FROM eqc),
a AS (SELECT count(*) AS sessions, max_by(equity, trade_date) AS fe, (max(trade_date)-min(trade_date))/365.25 AS years, 100*min(dd) AS mdd, avg(r)/stddev_samp(r)*sqrt(252) AS sharpe, (SELECT count(*) FROM (SELECT unnest(generate_series((SELECT min(trade_date) FROM eqc), (SELECT max(trade_date) FROM eqc), INTERVAL 1 DAY)) AS d) WHERE isodow(d)<=5) AS days FROM cr),
t AS (SELECT count(*) AS trades, sum(net_pnl) AS net, 100*avg(CAST(net_pnl>0 AS INT)) AS wr, sum(net_pnl) FILTER (WHERE net_pnl>0)/abs(sum(net_pnl) FILTER (WHERE net_pnl<0)) AS pf, avg((close_min-open_min)/1440) AS hold, max(net_pnl)/sum(net_pnl) FILTER (WHERE net_pnl>0) AS top FROM net)
SELECT sessions, trades, round(net, 4) AS net, round(fe, 4) AS final_equity, round(100*(fe/2000000-1), 6) AS return_pct, round(CASE WHEN fe>0 THEN 100*(power(fe/2000000, 1/years)-1) END, 6) AS cagr_pct, round(mdd, 6) AS max_drawdown_pct, round(sharpe, 6) AS sharpe, round(wr, 6) AS win_rate_pct,
 round(pf, 6) AS profit_factor, round(hold, 8) AS avg_hold_days, round(top, 8) AS top_trade_share, round(100*sessions/days, 6) AS exposure_pct, round(100*(fe/2000000-1)-12.5, 6) AS vs_benchmark_pp FROM a, t""")
def _(spark, sf):
    s = rc.swing_summary(trades(spark, sf), rc.equity_curve(sessions(spark, sf), CAPITAL), CAPITAL, 12.5)
    six = ("return_pct", "cagr_pct", "max_drawdown_pct", "sharpe", "win_rate_pct", "profit_factor", "exposure_pct", "vs_benchmark_pp")
    return s.withColumns({**{c: fixed(F.col(c), 4) for c in ("net", "final_equity")}, **{c: fixed(F.col(c)) for c in six}, **{c: fixed(F.col(c), 8) for c in ("avg_hold_days", "top_trade_share")}})


@query("record_fingerprint", f"""WITH {SESS} SELECT count(*) AS rows, CAST(sum(trades) AS BIGINT) AS trades, min(trade_date) AS first, max(trade_date) AS last, round(sum(net_pnl), 4) AS net, true AS same_as_reordered, false AS same_as_changed FROM ses""")
def _(spark, sf):
    from tapeloom.session import settle
    s = settle(sessions(spark, sf).withColumn("_net", fixed(F.col("net_pnl"))))
    cols = ["trade_date", "trades", "_net"]
    a = rc.record_fingerprint(s, cols)
    b = rc.record_fingerprint(s.repartition(7, "trades"), cols)
    changed = F.col("trade_date") == s.select(F.min("trade_date")).scalar()
    c = rc.record_fingerprint(s.withColumn("trades", F.col("trades") + changed.cast("int")), cols)
    same = rc.record_drift(a.drop("net"), b.drop("net")).select(F.col("matches").alias("same_as_reordered"))
    other = rc.record_drift(a.drop("net"), c.drop("net")).select(F.col("matches").alias("same_as_changed"))
    out = a.select("rows", "trades", "first", "last", fixed(F.col("net"), 4).alias("net"))
    return beside(beside(out, same), other)


@query("generated_vs_stored", f"""WITH {NET}, g AS (SELECT strategy, reason, count(*) AS trades FROM net GROUP BY ALL), s AS (SELECT strategy, reason, count(*)+CAST(reason='stop' AS INT) AS trades FROM net GROUP BY strategy, reason)
SELECT (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM s)) AS missing, (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM g)) AS unexpected, true AS differs""")
def _(spark, sf):
    g = rc.exit_mix(trades(spark, sf)).select("strategy", "reason", "trades")
    return rc.generated_vs_stored(g, g.withColumn("trades", F.col("trades") + (F.col("reason") == "stop").cast("long")))


@query("compared_by_digests", f"""WITH {q.WBARS}, g AS (SELECT symbol, date, close, volume FROM wbars),
s AS (SELECT symbol, date, CASE WHEN symbol%10=7 AND date=DATE '1998-03-02' THEN close+1 ELSE close END AS close, volume FROM g WHERE NOT (symbol%10=4 AND date=DATE '1999-03-01'))
SELECT (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM s)) AS missing, (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM g)) AS unexpected,
 (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM s))+(SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM g)) > 0 AS differs""")
def _(spark, sf):
    """Bars against a stored copy with one bar changed and one bar lost of every tenth symbol."""
    g = settle(src.weekly_bars(spark, sf).select("symbol", "date", "close", "volume"))
    tenth, day = F.col("symbol") % 10, F.col("date").cast("string")
    s = g.filter(~((tenth == 4) & (day == "1999-03-01"))).withColumn("close", F.col("close") + ((tenth == 7) & (day == "1998-03-02")).cast("int"))
    return dg.compared_by_digests(g, s, ["symbol", "date"])
