"""Identity, corporate actions and price hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed, log_or_inf
from tapeloom.operators import actions as act
from tapeloom.operators import hygiene as hyg
from tapeloom.operators import identity as ident
from tapeloom.session import settle
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.panel import _RAW, tidy
from tapeloom.suite.register import query

OBS = q.IDS + """, obs AS (SELECT symbol, isin, min(date) AS first, max(date) AS last FROM ids GROUP BY ALL),
flagged AS (SELECT *, coalesce(first - max(last) OVER (PARTITION BY symbol ORDER BY first, isin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 730, false) AS fresh FROM obs),
eras AS (SELECT symbol, isin, first, last, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY symbol ORDER BY first, isin) AS BIGINT) AS era FROM flagged)"""
ENT = OBS + """, edges AS (SELECT DISTINCT isin, concat(symbol, '#', era) AS node FROM eras),
reach(a, b) AS (SELECT isin, isin FROM edges UNION SELECT r.a, e2.isin FROM reach r JOIN edges e1 ON e1.isin=r.b JOIN edges e2 ON e2.node=e1.node),
ent AS (SELECT a AS isin, min(b) AS entity FROM reach GROUP BY a),
lab AS (SELECT o.*, e.entity FROM obs o JOIN ent e USING (isin)),
disp AS (SELECT entity, symbol AS display FROM lab QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last DESC, symbol DESC)=1),
s2e AS (SELECT symbol, entity FROM lab QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY last DESC, entity DESC)=1)"""
R = "WITH RECURSIVE "


def _ents(spark, sf):
    return ident.resolve_entities(src.identity_rows(spark, sf))


@query("identity_observations", f"WITH {OBS} SELECT * FROM obs")
def _(spark, sf):
    return ident.identity_observations(src.identity_rows(spark, sf))


@query("symbol_eras", f"WITH {OBS} SELECT symbol, isin, era FROM eras")
def _(spark, sf):
    return ident.symbol_eras(ident.identity_observations(src.identity_rows(spark, sf))).select("symbol", "isin", "era")


@query("resolve_entities", f"{R}{ENT} SELECT isin, entity FROM ent")
def _(spark, sf):
    return _ents(spark, sf).by_isin


@query("entity_display", f"{R}{ENT} SELECT entity, display FROM disp")
def _(spark, sf):
    return _ents(spark, sf).display()


@query("symbol_to_entity", f"{R}{ENT} SELECT symbol, entity FROM s2e")
def _(spark, sf):
    return _ents(spark, sf).by_symbol()


@query("entity_stats", f"""{R}{ENT} SELECT CAST(sum(n) AS BIGINT) AS isins, count(*) AS entities, count(*) FILTER (WHERE n>1) AS merged
FROM (SELECT entity, count(*) AS n FROM ent GROUP BY 1)""")
def _(spark, sf):
    return _ents(spark, sf).stats()


@query("entity_map_join", f"{R}{ENT} SELECT symbol, isin, date, entity FROM ids JOIN ent USING (isin)")
def _(spark, sf):
    rows = src.identity_rows(spark, sf)
    return ident.entity_map_join(rows, ident.resolve_entities(rows)).select("symbol", "isin", "date", "entity")


@query("suspicious_gaps", f"""{R}{ENT}, d AS (SELECT DISTINCT entity, date FROM ids JOIN ent USING (isin)),
g AS (SELECT entity, date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS gap FROM d)
SELECT entity, max(gap) AS max_gap_days, count(*) AS sessions, any_value(display) AS display FROM g JOIN disp USING (entity)
GROUP BY entity HAVING count(*)>=2 AND max(gap)>=180""")
def _(spark, sf):
    rows = src.identity_rows(spark, sf)
    ents = ident.resolve_entities(rows)
    return ident.suspicious_gaps(ident.entity_map_join(rows, ents)).join(ents.display(), "entity")


@query("entity_fallback_lookup", f"""{R}{ENT}, rec AS (SELECT o_orderkey AS rid, concat('S', o_custkey) AS symbol,
 concat('I', CASE WHEN o_orderkey%3=0 THEN -o_custkey ELSE o_custkey - o_custkey%3 END) AS isin FROM orders)
SELECT rid, coalesce(e.entity, s.entity) AS entity FROM rec LEFT JOIN ent e USING (isin) LEFT JOIN s2e s ON s.symbol=rec.symbol""")
def _(spark, sf):
    o = src.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rec = o.select(k.alias("rid"), F.concat(F.lit("S"), c.cast("string")).alias("symbol"),
                   F.concat(F.lit("I"), F.when(k % 3 == 0, -c).otherwise(c - c % 3).cast("string")).alias("isin"))
    return ident.entity_fallback_lookup(rec, _ents(spark, sf)).select("rid", "entity")


@query("entity_day_collapse", """WITH r AS (SELECT concat('E', o_custkey//4) AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
 o_custkey AS isin, o_orderkey AS seq, CASE WHEN o_orderstatus<>'P' THEN o_totalprice END AS close, CASE WHEN o_orderkey%2=0 THEN o_totalprice*2 END AS open FROM orders)
SELECT entity, date, max_by(close, (isin, seq)) FILTER (WHERE close IS NOT NULL) AS close, max_by(open, (isin, seq)) FILTER (WHERE open IS NOT NULL) AS open FROM r GROUP BY ALL""")
def _(spark, sf):
    o = src.table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("E"), F.floor(F.col("o_custkey") / 4).cast("string")).alias("entity"),
                    F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("isin"),
                    F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("close"),
                    F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 2).alias("open"))
    return ident.entity_day_collapse(rows, ["close", "open"], ["isin", "seq"])


@query("exact_key_guard", """SELECT c_custkey AS request_id, c_name AS symbol,
CASE WHEN c_nationkey%5=0 THEN NULL WHEN c_nationkey%3=0 THEN c_mktsegment ELSE lower(c_name) END AS code,
coalesce(c_nationkey%5<>0 AND c_nationkey%3<>0, false) AS accepted FROM customer""")
def _(spark, sf):
    c = src.table(spark, sf, "customer")
    asked = c.select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("symbol"))
    got = c.select(F.col("c_custkey").alias("request_id"),
                   F.when(F.col("c_nationkey") % 5 == 0, None).when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment"))
                   .otherwise(F.lower("c_name")).alias("code"))
    return ident.exact_key_guard(asked, got)


PARSED = q.ACTIONS + r""", parts AS (SELECT *, nullif(regexp_extract(subject, '(?i)bonus[^0-9]{0,8}(\d+)\s*:\s*(\d+)', 1), '') AS a,
 nullif(regexp_extract(subject, '(?i)bonus[^0-9]{0,8}(\d+)\s*:\s*(\d+)', 2), '') AS b, regexp_matches(subject, '(?i)split|sub-?division|\bspl') AS sp,
 nullif(regexp_extract(subject, '(?i)(?:rs\.?|re\.?)\s*(\d+(?:\.\d+)?)[^0-9]{0,24}?to\s*(?:rs\.?|re\.?)?\s*(\d+(?:\.\d+)?)', 1), '') AS o,
 nullif(regexp_extract(subject, '(?i)(?:rs\.?|re\.?)\s*(\d+(?:\.\d+)?)[^0-9]{0,24}?to\s*(?:rs\.?|re\.?)?\s*(\d+(?:\.\d+)?)', 2), '') AS n FROM actions),
facts AS (SELECT symbol, ex_date, subject, CAST(b AS DOUBLE)/(CAST(a AS DOUBLE)+CAST(b AS DOUBLE)) AS fb, a, b, o, n,
 CASE WHEN sp AND CAST(n AS DOUBLE)<CAST(o AS DOUBLE) THEN CAST(n AS DOUBLE)/CAST(o AS DOUBLE) END AS fs FROM parts),
parsed AS (SELECT symbol, ex_date, subject, CASE WHEN fb IS NOT NULL OR fs IS NOT NULL THEN coalesce(fb,1.0)*coalesce(fs,1.0) END AS factor,
 concat_ws(' + ', CASE WHEN fb IS NOT NULL THEN concat('bonus ',a,':',b) END, CASE WHEN fs IS NOT NULL THEN concat('split ',o,'->',n) END) AS kind FROM facts)"""
CHECKED = q.WBARS + ", " + PARSED + """, px AS (SELECT symbol, date, close/lag(close) OVER (PARTITION BY symbol ORDER BY date) AS observed FROM wbars),
checked AS (SELECT a.symbol, a.ex_date, a.subject, a.factor, p.observed, CASE WHEN p.observed IS NULL THEN 'out_of_range'
 WHEN abs(p.observed-a.factor)<=0.25*a.factor THEN 'confirmed' ELSE 'rejected' END AS status
 FROM parsed a LEFT JOIN px p ON p.symbol=a.symbol AND p.date=a.ex_date WHERE a.factor IS NOT NULL)"""


def _parsed(spark, sf):
    return act.parse_action_factor(src.action_texts(spark, sf))


def _checked(spark, sf):
    return act.confirm_actions(_parsed(spark, sf), src.weekly_bars(spark, sf))


@query("parse_action_factor", f"WITH {PARSED} SELECT symbol, ex_date, subject, round(factor, 9) AS factor, kind FROM parsed")
def _(spark, sf):
    return _parsed(spark, sf).withColumn("factor", fixed(F.col("factor"), 9))


@query("actions_tidy", f"""WITH {q.ACTIONS}, raw AS (SELECT CASE WHEN symbol%9=0 THEN NULL ELSE concat('I', symbol) END AS isin,
 CASE WHEN subject='' THEN 'soon' ELSE strftime(ex_date, '%d-%b-%Y') END AS d, subject FROM actions)
SELECT DISTINCT isin, CAST(try_strptime(d, '%d-%b-%Y') AS DATE) AS ex_date, subject FROM raw WHERE isin IS NOT NULL AND try_strptime(d, '%d-%b-%Y') IS NOT NULL""")
def _(spark, sf):
    a = src.action_texts(spark, sf)
    raw = a.select(F.when(F.col("symbol") % 9 != 0, F.concat(F.lit("I"), F.col("symbol").cast("string"))).alias("isin"),
                   F.when(F.col("subject") == "", "soon").otherwise(F.date_format("ex_date", "dd-MMM-yyyy")).alias("ex_date"), "subject")
    return act.actions_tidy(raw)


@query("action_price_join", f"""WITH {q.WBARS}, {q.ACTIONS}, px AS (SELECT symbol, date, close/lag(close) OVER (PARTITION BY symbol ORDER BY date) AS observed FROM wbars)
SELECT a.symbol, ex_date, subject, round(observed, 8) AS observed FROM actions a LEFT JOIN px ON px.symbol=a.symbol AND px.date=a.ex_date""")
def _(spark, sf):
    return act.action_price_join(src.action_texts(spark, sf), src.weekly_bars(spark, sf)).withColumn("observed", fixed(F.col("observed"), 8))


@query("confirm_actions", f"WITH {CHECKED} SELECT symbol, ex_date, subject, round(factor, 8) AS factor, round(observed, 8) AS observed, status FROM checked")
def _(spark, sf):
    return _checked(spark, sf).select("symbol", "ex_date", "subject", fixed(F.col("factor"), 8).alias("factor"),
                                      fixed(F.col("observed"), 8).alias("observed"), "status")


@query("confirmation_rate", f"""WITH {CHECKED} SELECT count(*) FILTER (WHERE status='confirmed') AS confirmed, count(*) FILTER (WHERE status='rejected') AS rejected,
count(*) FILTER (WHERE status='out_of_range') AS out_of_range, round(count(*) FILTER (WHERE status='confirmed')/nullif(count(*) FILTER (WHERE status<>'out_of_range'),0), 8) AS rate FROM checked""")
def _(spark, sf):
    return act.confirmation_rate(_checked(spark, sf)).withColumn("rate", fixed(F.col("rate"), 8))


@query("back_adjust", f"""WITH {CHECKED}, st AS (SELECT symbol, ex_date, factor FROM checked WHERE status='confirmed'),
adj AS (SELECT b.symbol, b.date, product(s.factor) AS adj FROM wbars b JOIN st s ON s.symbol=b.symbol AND s.ex_date>b.date GROUP BY ALL)
SELECT b.symbol, b.date, round(ln(coalesce(adj,1.0)), 9)+0.0 AS log_adjustment, round(ln(close*coalesce(adj,1.0)), 9) AS log_close, round(ln(open*coalesce(adj,1.0)), 9) AS log_open, volume
FROM wbars b LEFT JOIN adj USING (symbol, date)""")
def _(spark, sf):
    bars = settle(src.weekly_bars(spark, sf))
    checked = act.confirm_actions(_parsed(spark, sf), bars)
    out = act.back_adjust(bars, checked.filter(F.col("status") == "confirmed"))
    return out.select("symbol", "date", *[fixed(log_or_inf(F.col(c)), 9).alias(f"log_{c}") for c in ("adjustment", "close", "open")], "volume")


JUMPS = q.PANEL + """, rets AS (SELECT p.*, p.close/l.close-1 AS ret FROM panel p LEFT JOIN panel l ON l.symbol=p.symbol AND l.session_no=p.session_no-1),
cut AS (SELECT symbol, max(session_no) AS cut FROM rets WHERE ret < -0.42 OR ret > 0.90 GROUP BY 1)"""


@query("quarantine_jumps", f"""WITH {JUMPS} SELECT symbol, session_no, CASE WHEN cut IS NULL OR session_no>=cut THEN close END AS close,
CASE WHEN cut IS NULL OR session_no>=cut THEN open END AS open, volume FROM rets LEFT JOIN cut USING (symbol)""")
def _(spark, sf):
    return hyg.quarantine_jumps(src.panel(spark, sf)).select("symbol", "session_no", "close", "open", "volume")


@query("jump_report", f"""WITH {JUMPS} SELECT symbol, max(date) AS last_jump, count(*) AS jumps, round(max_by(ret, session_no), 8) AS last_return
FROM rets WHERE ret < -0.42 OR ret > 0.90 GROUP BY 1""")
def _(spark, sf):
    return hyg.jump_report(src.panel(spark, sf)).withColumn("last_return", fixed(F.col("last_return"), 8))


BAD = q.WBARS + """, r AS (SELECT *, close/lag(close) OVER w - 1 AS r FROM wbars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
r2 AS (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY date) AS rn FROM r),
bad AS (SELECT *, coalesce(abs(r)>0.5 AND r*rn<0 AND abs(rn)>0.6*abs(r), false) AS bad FROM r2)"""


@query("bad_prints", f"""WITH {BAD} SELECT symbol, date, bad, CASE WHEN NOT bad THEN close END AS close, CASE WHEN NOT bad THEN volume END AS volume FROM bad
QUALIFY count(*) FILTER (WHERE bad) OVER (PARTITION BY symbol) <= 5""")
def _(spark, sf):
    return hyg.mask_bad_prints(src.weekly_bars(spark, sf), 0.5, 0.6, 5).select("symbol", "date", "bad", "close", "volume")


@query("split_detect", f"""WITH {q.WBARS}, o AS (SELECT symbol, date, lag(close) OVER w/lag(close, 2) OVER w AS before, close/lag(close) OVER w AS obs, open/lag(close) OVER w AS op, lead(close) OVER w/close AS stay
 FROM wbars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t(label, value) AS (VALUES ('1/10',0.1::DOUBLE),('1/5',0.2),('1/4',0.25),('1/3',1/3),('2/5',0.4),('1/2',0.5),('3/5',0.6),('2/1',2.0),('5/1',5.0),('10/1',10.0)),
b AS (SELECT o.*, label, value, abs(obs/value-1) AS gap FROM o, t WHERE obs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY abs(obs/value-1), value)=1)
SELECT symbol, date, round(obs, 8) AS observed, label AS nearest FROM b WHERE abs(obs-1)>=0.35 AND gap<=0.05 AND abs(op/value-1)<=0.15 AND abs(stay-1)<0.35 AND coalesce(abs(before-1)<0.35, true)""")
def _(spark, sf):
    return hyg.split_detect(src.weekly_bars(spark, sf)).withColumn("observed", fixed(F.col("observed"), 8))


@query("panel_describe", f"""WITH {q.WBARS}, per AS (SELECT date, count(close) AS n FROM wbars GROUP BY 1)
SELECT count(*) AS sessions, min(date) AS first, max(date) AS last, min(n) AS least, median(n) AS middle, max(n) AS most,
min_by(n, date) AS at_start, max_by(n, date) AS at_end, (SELECT count(DISTINCT symbol) FROM wbars) AS names FROM per""")
def _(spark, sf):
    return hyg.panel_describe(src.weekly_bars(spark, sf))


def _built(spark, sf):
    acts = src.action_texts(spark, sf).select(
        F.concat(F.lit("S"), F.col("symbol").cast("string")).alias("symbol"),
        F.when(F.col("symbol") % 2 == 0, F.concat(F.lit("OLD"), F.col("symbol").cast("string")))
        .otherwise(F.concat(F.lit("INE"), F.lpad(F.col("symbol").cast("string"), 9, "0"))).alias("isin"), "ex_date", "subject")
    return hyg.build_panel(tidy(spark, sf), act.parse_action_factor(acts))


@query("build_panel", f"""WITH {_RAW}, {PARSED}, eq AS (SELECT *, min(isin) OVER (PARTITION BY symbol) AS entity FROM tidy WHERE series='EQ'),
day AS (SELECT entity, date, any_value(symbol) AS symbol, max_by(close, isin) AS close, max_by(open, isin) AS open, max_by(volume, isin) AS volume FROM
 (SELECT * FROM eq) GROUP BY ALL),
px AS (SELECT symbol, date, close/lag(close) OVER (PARTITION BY symbol ORDER BY date) AS observed FROM day),
ok AS (SELECT p.symbol, ex_date, factor FROM parsed a JOIN px p ON p.symbol=concat('S', a.symbol) AND p.date=a.ex_date
 WHERE factor IS NOT NULL AND abs(observed-factor)<=0.25*factor),
adj AS (SELECT b.symbol, b.date, product(s.factor) AS adj FROM day b JOIN ok s ON s.symbol=b.symbol AND s.ex_date>b.date GROUP BY ALL),
ad AS (SELECT entity, d.date, close*coalesce(adj,1.0) AS close, open*coalesce(adj,1.0) AS open, volume FROM day d LEFT JOIN adj USING (symbol, date)),
cal2 AS (SELECT date, row_number() OVER (ORDER BY date) AS sno FROM (SELECT DISTINCT date FROM ad)),
s AS (SELECT * FROM ad JOIN cal2 USING (date)),
r AS (SELECT a.*, a.close/b.close-1 AS ret FROM s a LEFT JOIN s b ON a.entity=b.entity AND b.sno=a.sno-1),
cut AS (SELECT entity, max(sno) AS cut FROM r WHERE ret < -0.42 OR ret > 0.90 GROUP BY 1)
SELECT entity, date, round(ln(CASE WHEN cut IS NULL OR sno>=cut THEN close END), 9) AS log_close, round(ln(CASE WHEN cut IS NULL OR sno>=cut THEN open END), 9) AS log_open, volume
FROM r LEFT JOIN cut USING (entity)""")
def _(spark, sf):
    return _built(spark, sf).panel.select("entity", "date", fixed(F.log("close"), 9).alias("log_close"), fixed(F.log("open"), 9).alias("log_open"), "volume")


@query("survivor_counts", f"""WITH {q.WBARS}, f AS (SELECT DISTINCT symbol FROM wbars WHERE year(date)=(SELECT year(min(date)) FROM wbars)),
l AS (SELECT symbol FROM wbars WHERE date=(SELECT max(date) FROM wbars))
SELECT (SELECT count(*) FROM f) AS first_year, (SELECT count(*) FROM l) AS at_end, (SELECT count(*) FROM f WHERE symbol NOT IN (SELECT symbol FROM l)) AS retained_gone""")
def _(spark, sf):
    from tapeloom.operators.statistics import survivor_counts
    return survivor_counts(src.weekly_bars(spark, sf))
