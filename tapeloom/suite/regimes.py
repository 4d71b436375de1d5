"""Regime of every session of the equal-weight benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.operators import regime as rg
from tapeloom.operators import statistics as st
from tapeloom.operators import xsection as xs
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.ranking import GATED, GATES, factors, score_sql
from tapeloom.suite.register import query
from tapeloom.suite.statistics import BREADTH

P = rg.RegimeParams(fast=10, slow=20, anchor=40)


def ef(col, alpha, least, alias):
    return f"CASE WHEN count({col}) OVER s >= {least} THEN list_reduce(list({col}) OVER s, lambda a, x: a + {alpha}*(x-a)) END AS {alias}"


def regime_sql(p):
    """Steps from ``bench`` and ``br`` to ``reg``."""
    return f""", r0 AS (SELECT *, greatest(high-low, abs(high-lag(close) OVER o), abs(low-lag(close) OVER o)) AS tr, abs(close-lag(close) OVER o) AS d, abs(close-lag(close, {p.slow}) OVER o) AS net FROM bench WINDOW o AS (ORDER BY session_no)),
r1 AS (SELECT *, row_number() OVER s AS bars, CASE WHEN count(*) OVER wa>={p.anchor} THEN avg(close) OVER wa END AS sma_anchor, {ef('close', f'(2.0::DOUBLE/{p.fast + 1})', 1, 'ema_fast')}, {ef('close', f'(2.0::DOUBLE/{p.slow + 1})', 1, 'ema_slow')}, {ef('tr', f'(1.0::DOUBLE/{p.atr})', p.atr, 'atr')},
 net/sum(d) OVER ws AS eff FROM r0 WINDOW s AS (ORDER BY session_no), wa AS (ORDER BY session_no ROWS BETWEEN {p.anchor - 1} PRECEDING AND CURRENT ROW), ws AS (ORDER BY session_no ROWS BETWEEN {p.slow - 1} PRECEDING AND CURRENT ROW)),
r2 AS (SELECT *, atr/close AS atr_pct FROM r1),
r3 AS (SELECT a.session_no, CASE WHEN count(b.atr_pct) FILTER (WHERE b.bars>a.bars-252)>={p.least_atr} THEN 100*(count(*) FILTER (WHERE b.atr_pct<a.atr_pct AND b.bars>a.bars-252)+(count(*) FILTER (WHERE b.atr_pct=a.atr_pct AND b.bars>a.bars-252)+1)/2)/count(b.atr_pct) FILTER (WHERE b.bars>a.bars-252) END AS atr_percentile,
 CASE WHEN count(b.eff) FILTER (WHERE b.bars<a.bars)>={p.least_efficiency} THEN 100.0*count(*) FILTER (WHERE b.bars<a.bars AND b.eff<a.eff)/count(b.eff) FILTER (WHERE b.bars<a.bars) END AS ep
 FROM r2 a JOIN r2 b ON b.bars BETWEEN a.bars-252 AND a.bars GROUP BY 1),
r4 AS (SELECT r2.*, CASE WHEN atr_pct IS NOT NULL THEN atr_percentile END AS atr_percentile, CASE WHEN eff IS NOT NULL THEN ep END AS ep, breadth FROM r2 JOIN r3 USING (session_no) LEFT JOIN br USING (session_no)),
r5 AS (SELECT *, CASE WHEN close>sma_anchor THEN 1 WHEN close<sma_anchor THEN -1 ELSE 0 END+CASE WHEN ema_fast>ema_slow THEN 1 WHEN ema_fast<ema_slow THEN -1 ELSE 0 END+CASE WHEN breadth>=0.55 THEN 1 WHEN breadth<=0.45 THEN -1 ELSE 0 END AS votes FROM r4),
reg AS (SELECT *, CASE WHEN votes>=2 THEN 1 WHEN votes<=-2 THEN -1 ELSE 0 END AS direction, CASE WHEN atr_percentile>=80 THEN 'volatile' WHEN eff IS NULL OR eff<0.1 THEN 'range' WHEN ep<65 THEN 'range' ELSE 'trend' END AS family,
 greatest(least((abs(votes)/3+least(abs(ema_fast-ema_slow)/greatest(abs(ema_slow), 1e-9)/0.02, 1.0)+CASE WHEN ep IS NOT NULL THEN ep/100 WHEN eff IS NOT NULL THEN least(eff/0.6, 1.0) ELSE 0 END)/3, 1.0), 0.0) AS confidence FROM r5 WHERE bars>={p.need})"""


REG = q.BENCH + BREADTH + regime_sql(P)


def table(spark, sf):
    p = src.panel(spark, sf)
    return rg.regime_table(src.benchmark(p), st.breadth(p, 10), P)


@query("regime_direction", f"WITH {REG} SELECT date, votes, direction FROM reg")
def _(spark, sf):
    return table(spark, sf).select("date", "votes", "direction")


@query("regime_family", f"WITH {REG} SELECT date, round(atr_percentile, 5) AS atr_percentile, round(eff, 6) AS efficiency, round(ep, 5) AS efficiency_percentile, family FROM reg")
def _(spark, sf):
    return table(spark, sf).select("date", fixed(F.col("atr_percentile"), 5).alias("atr_percentile"), fixed(F.col("efficiency")).alias("efficiency"),
                                   fixed(F.col("efficiency_percentile"), 5).alias("efficiency_percentile"), "family")


@query("regime_confidence", f"WITH {REG} SELECT date, round(confidence, 6) AS confidence FROM reg")
def _(spark, sf):
    return table(spark, sf).select("date", fixed(F.col("confidence")).alias("confidence"))


_RC = ("ema_fast", "ema_slow", "sma_anchor", "atr_pct", "breadth")


@query("regime_table", f"""WITH {REG} SELECT date, round(ln(close), 9) AS log_close, {', '.join(f'round({c}, 7) AS {c}' for c in _RC)}, concat(CASE direction WHEN 1 THEN 'bull' WHEN -1 THEN 'bear' ELSE 'neutral' END, '_', family) AS label,
direction>=0 AS allows_long, direction<=0 AS allows_short, concat_ws('; ', CASE WHEN close>sma_anchor THEN 'close above 40-session mean' WHEN close<sma_anchor THEN 'close below 40-session mean' END,
 CASE WHEN ema_fast>ema_slow THEN 'EMA10 above EMA20' WHEN ema_fast<ema_slow THEN 'EMA10 below EMA20' END, CASE WHEN breadth>=0.55 THEN 'breadth broad' WHEN breadth<=0.45 THEN 'breadth narrow' END,
 CASE WHEN direction=0 THEN 'evidence mixed' END, concat('family ', family)) AS reasons FROM reg""")
def _(spark, sf):
    return table(spark, sf).select("date", fixed(F.log("close"), 9).alias("log_close"), *[fixed(F.col(c), 7).alias(c) for c in _RC], "label", "allows_long", "allows_short",
                                   F.array_join("reasons", "; ").alias("reasons"))


@query("regime_shares", f"WITH {REG} SELECT family, count(*) AS sessions, round(count(*)/sum(count(*)) OVER (), 8) AS share, count(*)/sum(count(*)) OVER () >= 0.05 AS reached FROM reg GROUP BY 1")
def _(spark, sf):
    return rg.regime_shares(table(spark, sf)).withColumn("share", fixed(F.col("share"), 8))


_INVENTED = "['trend','range','volatile'][1+session_no%3] AS family, session_no%5%3-1 AS direction FROM factors)"
_KNOWN = GATED.replace(_INVENTED, "rgm.family, rgm.direction FROM factors JOIN rgm ON rgm.session_no=factors.session_no-1)")


@query("select_universe_by_regime", f"""WITH rgm AS (WITH {REG} SELECT session_no, family, direction FROM reg), {_KNOWN}, ok AS (SELECT * FROM gt WHERE gate='survived'), {score_sql('ok')}
SELECT date, symbol, round(score, 5)+0.0 AS score FROM sc QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, symbol) <= 15""")
def _(spark, sf):
    """Selection with the weights and direction of the regime that was known the session before."""
    rows = xs.with_known_regime(factors(spark, sf), table(spark, sf))
    return xs.select_universe(rows, 15, GATES).select("date", "symbol", fixed(F.col("score"), 5).alias("score"))
