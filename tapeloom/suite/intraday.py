"""Intraday features, rules and outcomes on hourly bars."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.operators import calendars as cal
from tapeloom.operators import intraday as idy
from tapeloom.operators import outcomes as oc
from tapeloom.operators import regime as rg
from tapeloom.operators import statistics as st
from tapeloom.operators import touches as tc
from tapeloom.operators import xsection as xs
from tapeloom.session import settle
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.panel import HSESS, SESSION
from tapeloom.suite.regimes import regime_sql
from tapeloom.suite.register import query
from tapeloom.suite.statistics import BREADTH

TIMES = idy.SessionTimes("06:00", "22:00", "07:00", "20:00", "21:00")
MOST = 0.9
COSTS = oc.CostParams()
SIZES = oc.SizeParams(participation_pct=500.0, min_notional=1500.0)
S = "(PARTITION BY symbol, trade_date ORDER BY bar_ts)"

CTX = HSESS + """, dly AS (SELECT symbol, trade_date, min_by(open, bar_ts) AS open, max(high) AS high, min(low) AS low, max_by(close, bar_ts) AS close, sum(volume) AS volume FROM hbars GROUP BY ALL),
d1 AS (SELECT *, greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w)) AS tr, row_number() OVER w AS n FROM dly WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
d2 AS (SELECT symbol, trade_date, close, n, quantile_cont(volume, 0.5) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mv,
 CASE WHEN n>=14 THEN list_reduce(list(tr) OVER w, lambda a, x: a + (x-a)/14) END AS atr FROM d1 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
ctx AS (SELECT s.symbol, s.trade_date, d.close AS prev_close, d.atr AS atr_daily, d.mv AS median_volume FROM (SELECT DISTINCT symbol, trade_date FROM sess) s
 ASOF LEFT JOIN (SELECT * FROM d2 WHERE n>=16 AND close>0) d ON d.symbol=s.symbol AND d.trade_date<s.trade_date)"""

FEAT = CTX + f""", f1 AS (SELECT *, (high+low+close)/3 AS typ, greatest(high-low, abs(high-lag(close) OVER {S}), abs(low-lag(close) OVER {S})) AS tr FROM sess),
f2 AS (SELECT *, row_number() OVER s AS n, CASE WHEN sum(volume) OVER s>0 THEN sum(typ*volume) OVER s/sum(volume) OVER s ELSE avg(typ) OVER s END AS vwap,
 max(high) FILTER (WHERE strftime(bar_ts, '%H:%M')<='07:00') OVER d AS or_high, min(low) FILTER (WHERE strftime(bar_ts, '%H:%M')<='07:00') OVER d AS or_low,
 list_reduce(list(tr) OVER s, lambda a, x: a + (x-a)/14) AS wil, avg(tr) OVER s AS mtr, quantile_cont(volume, 0.5) OVER p AS bv, quantile_cont(high-low, 0.5) OVER p AS brg,
 max(high) OVER s AS session_high, min(low) OVER s AS session_low, min(low) OVER l AS leg_low, max(high) OVER l AS leg_high, first_value(open) OVER s AS first_open, first_value(high) OVER s AS first_high,
 first_value(low) OVER s AS first_low, list(close) OVER s AS closes FROM f1
 WINDOW s AS {S}, d AS (PARTITION BY symbol, trade_date), p AS (PARTITION BY symbol, trade_date ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), l AS (PARTITION BY symbol, trade_date ORDER BY bar_ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
ft AS (SELECT *, CASE WHEN n>=14 AND wil>0 THEN wil WHEN n>=2 AND mtr>0 THEN mtr END AS atr, CASE WHEN n>=3 AND bv>0 THEN volume/bv END AS rel_volume, CASE WHEN brg>0 THEN (high-low)/brg END AS range_ratio,
 len(list_filter(closes, lambda x: x>vwap))/len(closes) AS side_fraction FROM f2)"""


class Desk:
    """The stages of one run; what several stages read is settled once."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def hourly(self):
        return settle(src.hourly_bars(self.spark, self.sf))

    @cached_property
    def sess(self):
        return settle(cal.session_split(self.hourly, *SESSION))

    @cached_property
    def context(self):
        return settle(idy.asof_strictly_before(idy.daily_from_bars(self.hourly), self.sess))

    @property
    def features(self):
        return idy.with_features(self.sess, TIMES)

    @property
    def rule_rows(self):
        return regimed(self.features.join(self.context, ["symbol", "trade_date"], "left"))

    @property
    def signals(self):
        registry = idy.RuleRegistry()
        for rule in (R_OPEN, R_PULL, R_BURST, R_REVERT, R_FADE):
            registry.register(rule)
        return registry.run(self.rule_rows)

    @property
    def routed(self):
        return idy.route_signals(self.signals, TIMES)

    @property
    def filled(self):
        return oc.next_bar_fill(self.routed, self.sess, COSTS.slippage_bps)

    @property
    def sized(self):
        return oc.size_columns(self.filled.join(self.context, ["symbol", "trade_date"], "left"), SIZES, COSTS.round_trip_rate, "fill_ref")

    @cached_property
    def closed(self):
        orders = settle(self.sized.filter("approved"))
        return oc.first_touch_exit(orders, self.sess, TIMES).withColumn("exit_price", oc.exit_price(COSTS.slippage_bps))


def sess(spark, sf):
    return cal.session_split(src.hourly_bars(spark, sf), *SESSION)


def context(spark, sf):
    return Desk(spark, sf).context


def keyed(df, *cols, digits=8):
    return df.select("symbol", "bar_ts", *[fixed(F.col(c), digits).alias(c) for c in cols])


@query("asof_strictly_before", f"WITH {CTX} SELECT symbol, trade_date, round(prev_close, 8) AS prev_close, round(atr_daily, 8) AS atr_daily, median_volume FROM ctx")
def _(spark, sf):
    c = context(spark, sf)
    return c.select("symbol", "trade_date", fixed(F.col("prev_close"), 8).alias("prev_close"), fixed(F.col("atr_daily"), 8).alias("atr_daily"), "median_volume")


@query("asof_last_known_mark", f"""WITH {q.HBARS}, tl AS (SELECT DISTINCT trade_date, bar_ts FROM hbars), fs AS (SELECT symbol, trade_date, min(bar_ts) AS f FROM hbars GROUP BY ALL),
g AS (SELECT symbol, trade_date, tl.bar_ts FROM fs JOIN tl USING (trade_date) WHERE tl.bar_ts>=f)
SELECT g.symbol, g.bar_ts, h.close, m.close AS mark FROM g LEFT JOIN hbars h USING (symbol, bar_ts) ASOF LEFT JOIN hbars m ON m.symbol=g.symbol AND m.bar_ts<=g.bar_ts""")
def _(spark, sf):
    return idy.asof_last_known_mark(src.hourly_bars(spark, sf)).select("symbol", "bar_ts", "close", "mark")


@query("session_vwap", f"WITH {FEAT} SELECT symbol, bar_ts, round(vwap, 8) AS vwap FROM ft")
def _(spark, sf):
    return keyed(sess(spark, sf).withColumn("vwap", idy.session_vwap()), "vwap")


@query("opening_range", f"WITH {FEAT} SELECT symbol, bar_ts, or_high, or_low FROM ft WHERE strftime(bar_ts, '%H:%M')>'07:00'")
def _(spark, sf):
    o = idy.with_opening_range(sess(spark, sf), "07:00").filter(idy.clock() > "07:00")
    return o.select("symbol", "bar_ts", "or_high", "or_low")


@query("intraday_atr", f"WITH {FEAT} SELECT symbol, bar_ts, round(atr, 8) AS atr FROM ft")
def _(spark, sf):
    return keyed(idy.with_intraday_atr(sess(spark, sf)), "atr")


@query("relative_volume", f"WITH {FEAT} SELECT symbol, bar_ts, round(rel_volume, 8) AS rel_volume FROM ft")
def _(spark, sf):
    return keyed(sess(spark, sf).withColumn("rel_volume", idy.relative_volume()), "rel_volume")


def features(spark, sf):
    return idy.with_features(sess(spark, sf), TIMES)


@query("session_extremes", f"WITH {FEAT} SELECT symbol, bar_ts, session_high, session_low FROM ft")
def _(spark, sf):
    return features(spark, sf).select("symbol", "bar_ts", "session_high", "session_low")


@query("range_expansion", f"WITH {FEAT} SELECT symbol, bar_ts, round(range_ratio, 8) AS range_ratio FROM ft")
def _(spark, sf):
    return keyed(sess(spark, sf).withColumn("range_ratio", idy.range_expansion()), "range_ratio")


@query("side_fraction", f"WITH {FEAT} SELECT symbol, bar_ts, round(side_fraction, 8) AS side_fraction FROM ft")
def _(spark, sf):
    return keyed(features(spark, sf), "side_fraction")


@query("pullback_leg", f"WITH {FEAT} SELECT symbol, bar_ts, leg_low, leg_high FROM ft")
def _(spark, sf):
    return features(spark, sf).select("symbol", "bar_ts", "leg_low", "leg_high")


def regimed(rows):
    """A family and direction per session, spread over the days of the data."""
    d = F.dayofmonth("trade_date")
    fam = F.element_at(F.array(F.lit("trend"), F.lit("range"), F.lit("volatile")), 1 + d % 3)
    out = rows.withColumns({"family": fam, "direction": (d + F.col("symbol")) % 5 % 3 - 1})
    return out.withColumns({"allows_long": F.col("direction") >= 0, "allows_short": F.col("direction") <= 0})


def rs(expr):
    return f"round(round_even(({expr})/0.05, 0)*0.05, 2)"


def rule_sql(no, name, fams, warm, base, long, short, beyond):
    """One rule in SQL: (condition, raw stop, target, confidence) per side."""
    parts = []
    for side, (cond, stop, target, conf) in (("long", long), ("short", short)):
        sign, allow = ("-", "direction>=0") if side == "long" else ("+", "direction<=0")
        order = "stop<entry AND entry<target" if side == "long" else "target<entry AND entry<stop"
        parts.append(f"""SELECT symbol, trade_date, bar_ts, '{side}' AS side, entry, stop, target, '{name}' AS strategy, confidence, {no} AS rule_no FROM
 (SELECT *, {rs(target)} AS target FROM (SELECT *, {rs(f"CASE WHEN abs(entry-raw)/entry>=0.0025 THEN raw ELSE entry{sign}entry*0.0025 END")} AS stop FROM
 (SELECT *, {stop} AS raw, {conf} AS confidence FROM rr WHERE family IN ({fams}) AND n>={warm} AND {base} AND {allow} AND {cond})))
 WHERE abs(entry-stop)/entry BETWEEN 0.0025 AND 0.9 AND stop>0 AND target>0 AND entry>0 AND {order}""")
    return " UNION ALL ".join(parts)


def cl(x, lo, hi):
    return f"greatest(least({x}, {hi}), {lo})"


RR = FEAT + f""", rr AS (SELECT ft.*, prev_close, atr_daily, median_volume, ['trend','range','volatile'][1+day(trade_date)%3] AS family, (day(trade_date)+symbol)%5%3-1 AS direction,
 {rs('close')} AS entry, extract(hour FROM bar_ts)*60+extract(minute FROM bar_ts) AS mnt, strftime(bar_ts, '%H:%M') AS clk, first_open-prev_close AS gap FROM ft LEFT JOIN ctx USING (symbol, trade_date))"""
_orc = lambda side: cl(f"least(0.35+0.15*(rel_volume-1.0), 0.75)+CASE WHEN direction={side} THEN 0.15 WHEN direction={-side} THEN -0.10 ELSE 0 END", 0.05, 0.95)
_vpc = lambda fr: cl(f"0.25+0.55*({fr}-0.55)/0.45+0.15*(1-least(abs(close-vwap)/atr/0.8, 1.0))", 0.05, 0.9)
_mbc = cl("0.30+0.10*(range_ratio-1.2)+0.08*(rel_volume-1.2)-CASE WHEN family='volatile' THEN 0.15 ELSE 0 END", 0.05, 0.9)
_vrc = lambda rj: cl(f"0.30+0.12*(abs((close-vwap)/atr)-0.6)+0.30*({rj})", 0.05, 0.9)
_gfc = lambda fl: cl(f"0.45+0.30*least({fl}, 1.0)-0.10*greatest(abs(gap)/atr_daily-1.5, 0.0)", 0.05, 0.9)
RULES = {
    "OpeningRangeBreakout": rule_sql(0, "OpeningRangeBreakout", "'trend'", 4, "or_high>or_low AND clk>'07:00' AND atr>0 AND rel_volume>=1.0 AND NOT coalesce(atr_daily>0 AND abs(gap)>1.5*atr_daily, false)",
        ("close>or_high+0.05*atr", "least(or_low, session_low)", "entry+2.0*(entry-stop)", _orc(1)), ("close<or_low-0.05*atr", "greatest(or_high, session_high)", "entry-2.0*(stop-entry)", _orc(-1)), False),
    "VWAPPullback": rule_sql(1, "VWAPPullback", "'trend'", 8, "atr>0 AND abs(close-vwap)/atr<=0.8",
        ("side_fraction>=0.55 AND close>open", "least(leg_low, entry-0.8*atr)", "entry+2.0*(entry-stop)", _vpc("side_fraction")),
        ("1.0-side_fraction>=0.55 AND close<open", "greatest(leg_high, entry+0.8*atr)", "entry-2.0*(stop-entry)", _vpc("1.0-side_fraction")), False),
    "MomentumBurst": rule_sql(2, "MomentumBurst", "'trend','volatile'", 6, "atr>0 AND high>low AND range_ratio>=1.2 AND rel_volume>=1.2",
        ("close>open AND (session_high-close)/greatest(session_high-session_low, 1e-9)<=0.3", "least(low, entry-1.0*atr)", "entry+2.0*(entry-stop)", _mbc),
        ("close<open AND (close-session_low)/greatest(session_high-session_low, 1e-9)<=0.3", "greatest(high, entry+1.0*atr)", "entry-2.0*(stop-entry)", _mbc), False),
    "VWAPReversion": rule_sql(3, "VWAPReversion", "'range'", 6, "mnt<=1215 AND atr>0 AND high>low",
        ("(close-vwap)/atr<=-0.6 AND (close-low)/(high-low)>=0.1", "least(low, entry-1.2*atr)", "vwap", _vrc("(close-low)/(high-low)")),
        ("(close-vwap)/atr>=0.6 AND (high-close)/(high-low)>=0.1", "greatest(high, entry+1.2*atr)", "vwap", _vrc("(high-close)/(high-low)")), True),
    "GapFade": rule_sql(4, "GapFade", "'range'", 4, "atr_daily>0 AND prev_close IS NOT NULL AND abs(gap)/atr_daily BETWEEN 0.05 AND 3.0 AND atr>0",
        ("gap<0 AND close>first_high AND (close-first_open)/abs(gap)>=0.1", "least(session_low, entry-0.8*atr)", "prev_close", _gfc("(close-first_open)/abs(gap)")),
        ("gap>0 AND close<first_low AND (first_open-close)/abs(gap)>=0.1", "greatest(session_high, entry+0.8*atr)", "prev_close", _gfc("(first_open-close)/abs(gap)")), True),
}
SIGCOLS = "symbol, bar_ts, side, entry, stop, target, round(confidence, 8) AS confidence"


def show(df, *more):
    return df.select("symbol", "bar_ts", "side", "entry", "stop", "target", fixed(F.col("confidence"), 8).alias("confidence"), *more)


R_OPEN = idy.opening_range_rule(TIMES, MOST, min_rel_volume=1.0, buffer=0.05)
R_PULL = idy.vwap_pullback_rule(MOST, min_side=0.55, touch=0.8)
R_BURST = idy.momentum_burst_rule(MOST, range_mult=1.2, volume_mult=1.2, tolerance=0.3)
R_REVERT = idy.vwap_reversion_rule(TIMES, MOST, entry_atr=0.6, min_reject=0.1)
R_FADE = idy.gap_fade_rule(MOST, min_gap=0.05, min_fill=0.1)


def _rule(key, rule):
    @query(key, f"WITH {RR} SELECT {SIGCOLS} FROM ({RULES[rule.name]})")
    def _(spark, sf):
        return show(Desk(spark, sf).rule_rows.transform(rule.generate))


_rule("sig_opening_range", R_OPEN)
_rule("sig_vwap_pullback", R_PULL)
_rule("sig_momentum_burst", R_BURST)
_rule("sig_vwap_reversion", R_REVERT)
_rule("sig_gap_fade", R_FADE)

_ROUTED = ", sig AS (" + " UNION ALL ".join(RULES.values()) + """),
tm AS (SELECT * FROM sig WHERE strftime(bar_ts, '%H:%M')>='07:00' AND strftime(bar_ts, '%H:%M')<'20:00'),
ag AS (SELECT symbol, trade_date, bar_ts, count(*) AS rules, count(DISTINCT side) AS sides, arg_max({'side': side, 'entry': entry, 'stop': stop, 'target': target, 'strategy': strategy, 'confidence': confidence}, (confidence, -rule_no)) AS b,
 product(1-least(greatest(confidence, 0.0), 0.99)) AS miss, max(stop) AS smax, min(stop) AS smin, max(target) AS tmax, min(target) AS tmin, array_to_string(list_sort(list_distinct(list(strategy))), '+') AS names FROM tm GROUP BY ALL),
mg AS (SELECT *, b.side AS side, b.entry AS entry, CASE WHEN b.side='long' THEN smax ELSE smin END AS ms, CASE WHEN b.side='long' THEN tmin ELSE tmax END AS mt FROM ag WHERE sides=1),
mv AS (SELECT *, rules>1 AND CASE WHEN side='long' THEN ms<entry AND entry<mt ELSE mt<entry AND entry<ms END AS ok FROM mg),
rtd AS (SELECT symbol, trade_date, bar_ts, side, entry, CASE WHEN ok THEN ms ELSE b.stop END AS stop, CASE WHEN ok THEN mt ELSE b.target END AS target, CASE WHEN ok THEN names ELSE b.strategy END AS strategy,
 CASE WHEN ok THEN least(1-miss, 0.95) ELSE b.confidence END AS confidence, rules FROM mv)"""
SIG = RR + _ROUTED


@query("rule_registry", f"WITH {SIG} SELECT {SIGCOLS}, strategy FROM sig")
def _(spark, sf):
    return show(Desk(spark, sf).signals, "strategy")


@query("route_signals", f"WITH {SIG} SELECT {SIGCOLS}, strategy, rules FROM rtd")
def _(spark, sf):
    return show(Desk(spark, sf).routed, "strategy", "rules")


# the index of these names has 30 days, so its own averages are short
KNOWN = rg.RegimeParams(fast=3, slow=6, anchor=8, atr=5, least_atr=3, least_efficiency=3)
_MADE_UP = "['trend','range','volatile'][1+day(trade_date)%3] AS family, (day(trade_date)+symbol)%5%3-1 AS direction"
RRK = FEAT + f""", cal AS (SELECT trade_date AS date, CAST(row_number() OVER (ORDER BY trade_date) AS INTEGER) AS session_no FROM (SELECT DISTINCT trade_date FROM dly)),
panel AS (SELECT symbol, date, session_no, high, low, close FROM dly JOIN cal ON cal.date=dly.trade_date),
bench AS (SELECT date, session_no, avg(close) AS close, avg(high) AS high, avg(low) AS low FROM panel GROUP BY ALL)
{BREADTH}{regime_sql(KNOWN)}, rgm AS (SELECT cal.date AS trade_date, family, direction FROM reg JOIN cal ON cal.session_no=reg.session_no+1)""" + \
    RR[len(FEAT):].replace(_MADE_UP, "rgm.family, rgm.direction").replace("USING (symbol, trade_date))", "USING (symbol, trade_date) JOIN rgm USING (trade_date))")


class KnownDesk(Desk):
    """Rules and routing under the regime of the session before, from the index of the traded names."""

    @cached_property
    def daily(self):
        return settle(src.with_sessions(idy.daily_from_bars(self.hourly).withColumnRenamed("trade_date", "date")))

    @property
    def rule_rows(self):
        regimes = settle(rg.regime_table(src.benchmark(self.daily), st.breadth(self.daily, 10), KNOWN))
        days = self.daily.select(F.col("date").alias("trade_date"), "session_no").distinct()
        rows = self.features.join(F.broadcast(days), "trade_date").join(self.context, ["symbol", "trade_date"], "left")
        return xs.with_known_regime(rows, regimes).withColumns({"allows_long": F.col("direction") >= 0, "allows_short": F.col("direction") <= 0})


@query("rule_registry_by_regime", f"WITH {RRK}{_ROUTED} SELECT {SIGCOLS}, strategy FROM sig")
def _(spark, sf):
    return show(KnownDesk(spark, sf).signals, "strategy")


@query("route_signals_by_regime", f"WITH {RRK}{_ROUTED} SELECT {SIGCOLS}, strategy, rules FROM rtd")
def _(spark, sf):
    return show(KnownDesk(spark, sf).routed, "strategy", "rules")


@query("signal_validity", f"""WITH {SIG}, j AS (SELECT symbol, bar_ts, strategy, side, entry, CASE WHEN extract(hour FROM bar_ts)%3=0 THEN entry*2 WHEN extract(hour FROM bar_ts)%3=1 THEN -stop ELSE stop END AS stop, target FROM sig)
SELECT symbol, bar_ts, strategy, coalesce(stop>0 AND CASE WHEN side='long' THEN stop<entry AND entry<target ELSE target<entry AND entry<stop END, false) AS valid, round(abs(target-entry)/abs(entry-stop), 8) AS reward_risk FROM j""")
def _(spark, sf):
    h = F.hour("bar_ts") % 3
    j = Desk(spark, sf).signals.withColumn("stop", F.when(h == 0, F.col("entry") * 2).when(h == 1, -F.col("stop")).otherwise(F.col("stop")))
    return j.select("symbol", "bar_ts", "strategy", idy.signal_validity().alias("valid"), fixed(idy.reward_risk(), 8).alias("reward_risk"))


@query("stop_clamp", f"""WITH {HSESS}, c AS (SELECT symbol, bar_ts, close, CASE WHEN abs(close-low)/close>=0.0025 THEN low ELSE close-close*0.0025 END AS stop FROM sess WHERE close>0)
SELECT symbol, bar_ts, round(stop, 8) AS stop, abs(close-stop)/close BETWEEN 0.0025 AND 0.03 AS sane FROM c""")
def _(spark, sf):
    c = sess(spark, sf).filter(F.col("close") > 0).withColumn("stop", idy.clamp_stop(F.col("close"), F.col("low"), "long"))
    return c.select("symbol", "bar_ts", fixed(F.col("stop"), 8).alias("stop"), idy.stop_is_sane(F.col("close"), F.col("stop")).alias("sane"))


@query("signals_latest_session", f"WITH {SIG} SELECT {SIGCOLS}, strategy FROM rtd WHERE (symbol, trade_date) IN (SELECT symbol, max(trade_date) FROM sess GROUP BY 1)")
def _(spark, sf):
    d = Desk(spark, sf)
    return show(idy.signals_latest_session(d.routed, d.sess), "strategy")


FILL = SIG + f""", nb AS (SELECT symbol, trade_date, bar_ts, lead(bar_ts) OVER {S} AS fill_ts, lead(open) OVER {S} AS fill_ref FROM sess),
fl AS (SELECT r.*, fill_ts, fill_ref, CASE WHEN side='long' THEN fill_ref+fill_ref*5.0/1e4 ELSE fill_ref-fill_ref*5.0/1e4 END AS fill_price FROM rtd r JOIN nb USING (symbol, trade_date, bar_ts)
 WHERE fill_ts IS NOT NULL AND CASE WHEN side='long' THEN stop<fill_ref AND fill_ref<target ELSE target<fill_ref AND fill_ref<stop END)"""


@query("next_bar_fill", f"WITH {FILL} SELECT symbol, bar_ts, side, fill_ts, fill_ref, round(fill_price, 8) AS fill_price FROM fl")
def _(spark, sf):
    return Desk(spark, sf).filled.select("symbol", "bar_ts", "side", "fill_ts", "fill_ref", fixed(F.col("fill_price"), 8).alias("fill_price"))


SIZE = FILL + """, sz0 AS (SELECT f.*, floor(200/(abs(fill_ref-stop)+fill_ref*0.00246)) AS q1, floor(36000/fill_ref) AS q2, CASE WHEN median_volume>0 THEN floor(median_volume*5) END AS q3 FROM fl f LEFT JOIN ctx USING (symbol, trade_date)),
sz AS (SELECT *, CAST(greatest(least(q1, q2, q3), 0) AS BIGINT) AS quantity, CASE least(q1, q2, q3) WHEN q1 THEN 'risk_budget' WHEN q2 THEN 'position_notional' ELSE 'participation' END AS binding_cap FROM sz0),
szd AS (SELECT *, CASE WHEN q1<1 THEN 'budget' WHEN quantity<1 THEN 'cap allows none' WHEN quantity*fill_ref<1500 THEN 'below notional floor' ELSE 'ok' END AS decision FROM sz)"""


@query("size_columns", f"WITH {SIZE} SELECT symbol, bar_ts, quantity, binding_cap, decision FROM szd")
def _(spark, sf):
    return Desk(spark, sf).sized.select("symbol", "bar_ts", "quantity", "binding_cap", "decision")


EXIT = SIZE + """, en AS (SELECT symbol, trade_date, bar_ts AS exit_ts, high, low, close, strftime(bar_ts, '%H:%M')>='21:00' OR bar_ts=max(bar_ts) OVER (PARTITION BY symbol, trade_date) AS fin FROM sess),
tch AS (SELECT f.symbol, f.trade_date, f.bar_ts, exit_ts, CASE WHEN exit_ts>fill_ts AND CASE WHEN side='long' THEN low<=stop ELSE high>=stop END THEN 'stop' WHEN exit_ts>fill_ts AND CASE WHEN side='long' THEN high>=target ELSE low<=target END THEN 'target'
  WHEN fin THEN 'squareoff' END AS reason, close, stop, target FROM szd f JOIN en USING (symbol, trade_date) WHERE decision='ok' AND exit_ts>=fill_ts),
ext AS (SELECT symbol, trade_date, bar_ts, exit_ts, reason, CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE close END AS exit_ref FROM tch WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY exit_ts)=1),
cd0 AS (SELECT s.*, exit_ts, reason, exit_ref, CASE WHEN side='long' THEN exit_ref-exit_ref*5.0/1e4 ELSE exit_ref+exit_ref*5.0/1e4 END AS exit_price, CASE WHEN side='long' THEN 1 ELSE -1 END AS sgn FROM szd s JOIN ext USING (symbol, trade_date, bar_ts)),
cd AS (SELECT *, sgn*(exit_price-fill_price)*quantity AS gross_pnl, (exit_price+fill_price)*quantity*14.6/2e4 AS costs FROM cd0)"""


@query("first_touch_exit", f"WITH {EXIT} SELECT symbol, bar_ts, exit_ts, reason, exit_ref FROM cd")
def _(spark, sf):
    return Desk(spark, sf).closed.select("symbol", "bar_ts", "exit_ts", "reason", "exit_ref")


@query("first_touch_by_blocks", f"WITH {EXIT} SELECT symbol, bar_ts, exit_ts, reason, exit_ref FROM cd")
def _(spark, sf):
    d = Desk(spark, sf)
    blocks = settle(tc.blocks_of_bars(d.sess, TIMES))
    return tc.first_touch_by_blocks(d.sized.filter("approved"), blocks).select("symbol", "bar_ts", "exit_ts", "reason", "exit_ref")


@query("trade_pnl", f"WITH {EXIT} SELECT symbol, bar_ts, round(gross_pnl, 6)+0.0 AS gross_pnl, round(costs, 6) AS costs, round(gross_pnl-costs, 6)+0.0 AS net_pnl, gross_pnl-costs>0 AS win FROM cd")
def _(spark, sf):
    t = oc.trade_pnl(Desk(spark, sf).closed, COSTS)
    return t.select("symbol", "bar_ts", *[fixed(F.col(c)).alias(c) for c in ("gross_pnl", "costs", "net_pnl")], "win")


@query("slippage_measure", f"""WITH {EXIT} SELECT trade_date, round(sum((fill_ref+exit_ref)*quantity*5.0/1e4), 6) AS modelled_slippage,
round(sum(sgn*(fill_price-entry)*quantity+abs(exit_price-exit_ref)*quantity), 6)+0.0 AS observed_slippage, 'market' AS slippage_source FROM cd GROUP BY 1""")
def _(spark, sf):
    m = oc.slippage_measure(Desk(spark, sf).closed, COSTS.slippage_bps)
    return m.select("trade_date", fixed(F.col("modelled_slippage")).alias("modelled_slippage"), fixed(F.col("observed_slippage")).alias("observed_slippage"), "slippage_source")


@query("excursion", f"""WITH {EXIT} SELECT c.symbol, c.bar_ts, round(CASE WHEN any_value(side)='long' THEN greatest(any_value(fill_price), max(b.high)) ELSE least(any_value(fill_price), min(b.low)) END, 8) AS best_price
FROM cd c LEFT JOIN sess b ON b.symbol=c.symbol AND b.trade_date=c.trade_date AND b.bar_ts>c.fill_ts AND b.bar_ts<=c.exit_ts GROUP BY 1, 2""")
def _(spark, sf):
    d = Desk(spark, sf)
    return oc.excursion(d.closed, d.sess).select("symbol", "bar_ts", fixed(F.col("best_price"), 8).alias("best_price"))


@query("excursion_by_blocks", f"""WITH {EXIT} SELECT c.symbol, c.bar_ts, round(CASE WHEN any_value(side)='long' THEN greatest(any_value(fill_price), max(b.high)) ELSE least(any_value(fill_price), min(b.low)) END, 8) AS best_price
FROM cd c LEFT JOIN sess b ON b.symbol=c.symbol AND b.trade_date=c.trade_date AND b.bar_ts>c.fill_ts AND b.bar_ts<=c.exit_ts GROUP BY 1, 2""")
def _(spark, sf):
    d = Desk(spark, sf)
    blocks = settle(tc.blocks_of_bars(d.sess, TIMES))
    closed = settle(tc.first_touch_by_blocks(d.sized.filter("approved"), blocks))
    return tc.excursion_by_blocks(closed, blocks).select("symbol", "bar_ts", fixed(F.col("best_price"), 8).alias("best_price"))


@query("cost_model", f"WITH {q.TRADES} SELECT trade_id, round(entry_price*quantity*14.6/1e4, 9) AS statutory, round(entry_price*quantity*10.0/1e4, 9) AS slippage, round(entry_price*quantity*24.6/1e4, 9) AS round_trip FROM trades")
def _(spark, sf):
    c = oc.cost_model(src.trades(spark, sf), COSTS)
    return c.select("trade_id", *[fixed(F.col(x), 9).alias(x) for x in ("statutory", "slippage", "round_trip")])


@query("signal_rule", f"""WITH {RR} SELECT symbol, bar_ts, 'long' AS side, entry, {rs('entry*0.99')} AS stop, {rs('entry*1.02')} AS target, CAST(0.5 AS DOUBLE) AS confidence FROM rr
WHERE family='trend' AND n>=3 AND direction>=0 AND close>vwap AND close>open""")
def _(spark, sf):
    """A rule written by a user: buy an up bar above the session average."""
    up = idy.Setup("long", (F.col("close") > F.col("vwap")) & (F.col("close") > F.col("open")), lambda e: e * 0.99, lambda e, stop: e * 1.02, F.lit(0.5))
    rule = idy.Rule("UpBar", lambda: [up], ("trend",))
    return show(Desk(spark, sf).rule_rows.transform(rule.generate))
