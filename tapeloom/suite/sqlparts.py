"""CTE texts that give DuckDB the same inputs the Spark queries derive from the tables."""

WBARS = """wticks AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  CAST(round(1e6*ln(l_extendedprice/l_quantity)) AS BIGINT) AS tick, CAST(l_quantity AS BIGINT) AS qty,
  row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rn,
  count(*) OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)) AS n FROM lineitem),
wbars AS (SELECT symbol, date, max(CASE WHEN rn=1 THEN tick END)/1e4 AS open, max(tick)/1e4 AS high,
  min(tick)/1e4 AS low, max(CASE WHEN rn=n THEN tick END)/1e4 AS close, CAST(sum(qty) AS DOUBLE) AS volume,
  sum(qty*tick)/1e4 AS turnover FROM wticks GROUP BY symbol, date)"""

PANEL = WBARS + """,
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS session_no FROM (SELECT DISTINCT date FROM wbars)),
panel AS (SELECT b.*, c.session_no FROM wbars b JOIN cal c USING (date))"""

BENCH = PANEL + """,
bench AS (SELECT date, session_no, avg(close) AS close, avg(high) AS high, avg(low) AS low FROM panel GROUP BY ALL)"""

HBARS = """hticks AS (SELECT user_id%5 AS symbol, CAST(ts AS DATE) AS trade_date, date_trunc('hour', ts) AS bar_ts, value+500.0 AS px,
  row_number() OVER (PARTITION BY user_id%5, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id%5, date_trunc('hour', ts)) AS n FROM events),
hbars AS (SELECT symbol, trade_date, bar_ts, max(CASE WHEN rn=1 THEN px END) AS open, max(px) AS high, min(px) AS low,
  max(CASE WHEN rn=n THEN px END) AS close, CAST(count(*) AS DOUBLE) AS volume FROM hticks
  GROUP BY symbol, trade_date, bar_ts)"""

IDS = """ids AS (SELECT concat('S', CAST(o_custkey AS STRING)) AS symbol,
  concat('I', CAST(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN o_custkey - o_custkey%3 ELSE o_custkey END AS STRING)) AS isin,
  CAST(o_orderdate AS DATE) AS date FROM orders)"""

ACTIONS = """actions AS (SELECT o_custkey % 100 AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS ex_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN concat('Bonus ', CAST(1+o_custkey%4 AS STRING), ':', CAST(1+o_orderkey%3 AS STRING))
   WHEN '2-HIGH' THEN 'Fv Split-Rs.10/-To Rs.2/-'
   WHEN '3-MEDIUM' THEN concat('Spl-Rs10 To Rs', CAST(1+o_custkey%9 AS STRING), '/Bonus-1:2')
   WHEN '4-NOT SPECIFIED' THEN 'Dividend - Re 0.40 Per Sh' ELSE '' END AS subject FROM orders)"""

TRADES = """trades AS (SELECT o_orderkey AS trade_id, CAST(o_orderdate AS DATE) AS trade_date, o_custkey AS symbol, o_orderpriority AS strategy,
  CASE o_orderstatus WHEN 'F' THEN 'stop' WHEN 'O' THEN 'target' ELSE 'squareoff' END AS reason,
  CASE WHEN o_orderkey%2=0 THEN 'long' ELSE 'short' END AS side, 1+o_orderkey%50 AS quantity,
  555+o_orderkey%300 AS open_min, 560+o_orderkey%300+o_custkey%60 AS close_min,
  o_totalprice/100 AS entry_price, (o_totalprice-250000)/1000 AS gross_pnl,
  o_totalprice*2.82e-5 AS costs FROM orders)"""

LOGS = """logs AS (SELECT event_id, concat(substr(CAST(ts AS STRING),1,19), ' ',
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END, ' SYM', chr(CAST(65+user_id%26 AS INT)),
  ' D 2024-01-', CASE WHEN event_id%2=0 THEN '06..2024-01-07' ELSE '08..2024-01-12' END,
  CASE WHEN event_id%3=0 THEN ' getaddrinfo failed 0x' ELSE ' DH-' END, CAST(900+user_id%9 AS STRING)) AS line FROM events)"""

FUNDAMENTALS = """fundamentals AS (SELECT p_partkey AS symbol, p_brand AS sector, p_type AS category, p_retailprice AS price,
  CASE WHEN p_partkey%7=0 THEN NULL ELSE p_retailprice*power(1e1, p_size%9-4) END AS market_cap_cr,
  CASE WHEN p_partkey%11=0 THEN NULL ELSE p_partkey%60 END AS age_days FROM part)"""

MOM = PANEL + """,
mom AS (SELECT p.*, r.close AS c_skip, l.close AS c_look, r.close/l.close - 1 AS score,
  x.med AS med_turnover
  FROM panel p LEFT JOIN panel r ON r.symbol=p.symbol AND r.session_no=p.session_no-4
  LEFT JOIN panel l ON l.symbol=p.symbol AND l.session_no=p.session_no-52
  LEFT JOIN (SELECT a.symbol, a.session_no, CASE WHEN count(*)>=6 THEN median(b.turnover) END AS med
     FROM panel a JOIN panel b ON a.symbol=b.symbol AND b.session_no BETWEEN a.session_no-11 AND a.session_no
     GROUP BY ALL) x ON x.symbol=p.symbol AND x.session_no=p.session_no),
elig AS (SELECT *, coalesce(med_turnover>=26000 AND close>=600 AND c_skip IS NOT NULL AND c_look IS NOT NULL, false) AS eligible FROM mom)"""
