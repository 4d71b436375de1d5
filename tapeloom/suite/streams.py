"""Streams over the event ticks, run to completion and read back; the SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.sources import tables as src
from tapeloom.streaming import bars as sb
from tapeloom.streaming import halts, sinks
from tapeloom.streaming import states as st
from tapeloom.suite import intraday as si
from tapeloom.suite import sqlparts as q
from tapeloom.suite.panel import scratch
from tapeloom.suite.records import NET, sessions, trades
from tapeloom.suite.register import query


def to_ticks(rows):
    return rows.select((F.col("user_id") % 5).alias("symbol"), "ts", "event_id", "event_type", (F.col("value") + 500.0).alias("px"), F.lit(1.0).alias("qty"))


def ticks(spark, sf):
    schema = src.table(spark, sf, "events").schema
    return to_ticks(sb.tick_stream(spark, sf, schema, "events.parquet"))


def finish(spark, stream, name, schema=None):
    base = scratch(spark, name)
    sb.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def plain(df, *cols):
    """Zoned timestamps back to the tables' plain ones."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def closed(grace):
    return f"bar_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {grace}"


@query("stream_bars", f"WITH {q.HBARS} SELECT symbol, bar_ts, open, high, low, close, volume FROM hbars WHERE {closed('0 SECOND')}")
def _(spark, sf):
    return plain(finish(spark, sb.stream_bars(ticks(spark, sf), "1 hour", "0 seconds"), "bars"), "bar_ts")


@query("stream_confirmed_bars", f"WITH {q.HBARS} SELECT symbol, bar_ts, close, volume FROM hbars WHERE {closed('5 SECOND')}")
def _(spark, sf):
    return plain(finish(spark, sb.stream_bars(ticks(spark, sf), "1 hour"), "confirmed"), "bar_ts").select("symbol", "bar_ts", "close", "volume")


@query("stream_late_drop", """WITH a AS (SELECT *, date_trunc('hour', ts) AS bar_ts FROM events WHERE event_type<>'signup'), wm AS (SELECT max(ts) - INTERVAL 10 DAY AS w FROM a),
b AS (SELECT *, date_trunc('hour', ts) AS bar_ts FROM events WHERE event_type='signup' AND date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT w FROM wm)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT user_id%5 AS symbol, bar_ts, CAST(count(*) AS DOUBLE) AS volume FROM u
WHERE bar_ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM u) - INTERVAL 10 DAY GROUP BY ALL""")
def _(spark, sf):
    """One kind of event arrives after all others: what still fits the watermark counts, the rest is dropped."""
    base = scratch(spark, "late")
    e = src.table(spark, sf, "events")
    for late in (False, True):
        e.filter((F.col("event_type") == "signup") == F.lit(late)).write.mode("append").parquet(f"{base}/in")
        stream = sb.stream_bars(to_ticks(sb.tick_stream(spark, f"{base}/in", e.schema)), "1 hour", "10 days")
        sb.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return plain(spark.read.schema(stream.schema).parquet(f"{base}/out"), "bar_ts").select("symbol", "bar_ts", "volume")


@query("stream_dedupe", "SELECT event_id, user_id%5 AS symbol, ts FROM events")
def _(spark, sf):
    """Every tick is polled twice."""
    base = scratch(spark, "dedupe")
    e = src.table(spark, sf, "events")
    for _poll in range(2):
        e.write.mode("append").parquet(f"{base}/in")
        stream = sb.stream_dedupe(to_ticks(sb.tick_stream(spark, f"{base}/in", e.schema)), ["symbol", "event_id"], "60 days")
        sb.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return plain(spark.read.schema(stream.schema).parquet(f"{base}/out"), "ts").select("event_id", "symbol", "ts")


@query("stream_session_vwap", """SELECT user_id%5 AS symbol, CAST(ts AS DATE) AS trade_date, round(sum(value+500.0)/count(*), 8) AS vwap, max(value+500.0) AS session_high, min(value+500.0) AS session_low FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND GROUP BY ALL""")
def _(spark, sf):
    v = states(spark, sf, st.stream_sessions, "vwap").filter("kind = 'final'")
    return v.select("symbol", "trade_date", fixed(F.col("vwap"), 8).alias("vwap"), "session_high", "session_low")


@query("stream_stale_symbols", """WITH g AS (SELECT user_id AS symbol, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT symbol, max(ts) AS last_tick, max(ts) + INTERVAL 12 HOUR AS stale_from, count(*) AS ticks FROM g GROUP BY symbol, s HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND""")
def _(spark, sf):
    e = sb.tick_stream(spark, sf, src.table(spark, sf, "events").schema, "events.parquet").withColumn("symbol", F.col("user_id"))
    return plain(finish(spark, sb.stream_stale_symbols(e, "12 hours"), "stale"), "last_tick", "stale_from")


def states(spark, sf, stream, name):
    """Rows of a state machine over the ticks."""
    base, out = scratch(spark, name), stream(ticks(spark, sf))
    st.run_states(out, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("stream_session_square_off", """WITH t AS (SELECT user_id%5 AS symbol, CAST(ts AS DATE) AS trade_date, ts, value+500.0 AS px FROM events WHERE CAST(ts AS TIME) < TIME '18:00:00')
SELECT symbol, trade_date, round(avg(px), 8) AS vwap, max(px) AS session_high, min(px) AS session_low, count(*) AS ticks, max(ts) AS as_of FROM t
WHERE trade_date + INTERVAL 18 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND GROUP BY ALL""")
def _(spark, sf):
    """Final values of every session that was squared off, each from its own timer."""
    rows = states(spark, sf, lambda t: st.stream_sessions(t, 18 * 60), "squareoff").filter("kind = 'final'")
    return plain(rows, "as_of").select("symbol", "trade_date", fixed(F.col("vwap"), 8).alias("vwap"), "session_high", "session_low", "ticks", "as_of")


@query("stream_silence", """WITH g AS (SELECT user_id%5 AS symbol, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id%5 ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id%5 ORDER BY ts, event_id) AS p FROM events)),
w AS (SELECT symbol, s, min(ts) AS begin, max(ts) AS last, count(*) AS ticks FROM g GROUP BY symbol, s)
SELECT symbol, 'silent' AS kind, last + INTERVAL 1 HOUR AS at, ticks FROM w WHERE last + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND
UNION ALL SELECT symbol, 'back', begin, 0 FROM w WHERE s > 1""")
def _(spark, sf):
    """Silences of an hour and returns, by one timer a symbol that every tick puts off."""
    return plain(states(spark, sf, lambda t: st.stream_silence(t, "1 hour"), "silence"), "at").select("symbol", "kind", "at", "ticks")


_STREAM_SIG = si.SIG.replace("OVER (PARTITION BY symbol, trade_date) >= 10)", f"OVER (PARTITION BY symbol, trade_date) >= 1 AND {closed('5 SECOND')})")


@query("stream_signals", f"WITH {_STREAM_SIG} SELECT {si.SIGCOLS}, strategy, rules FROM rtd WHERE {closed('5 SECOND')}")
def _(spark, sf):
    base = scratch(spark, "signals")
    ctx = si.context(spark, sf)
    reg = si.idy.RuleRegistry()
    for rule in (si.R_OPEN, si.R_PULL, si.R_BURST, si.R_REVERT, si.R_FADE):
        reg.register(rule)
    sink = sinks.SignalSink(base, lambda f: si.regimed(f.join(ctx, ["symbol", "trade_date"], "left")), reg, si.TIMES)
    sinks.run_batches(sb.stream_bars(ticks(spark, sf), "1 hour"), sink, f"{base}/checkpoint")
    out = spark.read.parquet(f"{base}/signals").drop("batch")
    return si.show(plain(out, "bar_ts"), "strategy", "rules")


ACKS = "extract(day FROM trade_date)=1 AND extract(month FROM trade_date)%2=0"
HALT = NET + f""", nr AS (SELECT strategy AS account, trade_date, 0 AS k, sum(net_pnl) AS v FROM net GROUP BY ALL), ar AS (SELECT account, trade_date, 1 AS k, 0.0 AS v FROM nr WHERE {ACKS}),
al AS (SELECT *, sum(v) OVER w AS equity FROM (SELECT * FROM nr UNION ALL SELECT * FROM ar) WINDOW w AS (PARTITION BY account ORDER BY trade_date, k)),
pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY account ORDER BY trade_date, k), 0) AS peak, row_number() OVER (PARTITION BY account ORDER BY trade_date, k) AS i FROM al),
ls AS (SELECT *, max(CASE WHEN k=0 AND peak-equity>=2000 THEN i END) OVER w AS lt, max(CASE WHEN k=1 THEN i END) OVER w AS la FROM pk WINDOW w AS (PARTITION BY account ORDER BY i))"""


@query("stream_sticky_halt", f"""WITH {HALT} SELECT account, trade_date, CASE k WHEN 0 THEN 'net' ELSE 'ack' END AS kind, round(equity, 3)+0.0 AS equity, round(peak, 3)+0.0 AS peak, coalesce(lt>coalesce(la, 0), false) AS tripped FROM ls""")
def _(spark, sf):
    base = scratch(spark, "halts")
    net = trades(spark, sf).groupBy(F.col("strategy").alias("account"), "trade_date").agg(F.sum("net_pnl").alias("value")).withColumn("kind", F.lit("net"))
    ack = net.filter((F.dayofmonth("trade_date") == 1) & (F.month("trade_date") % 2 == 0)).withColumns({"kind": F.lit("ack"), "value": F.lit(0.0)})
    events = net.unionByName(ack)
    split = F.lit("1998-07-01").cast("date")
    for part in (F.col("trade_date") < split, F.col("trade_date") >= split):
        events.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = halts.stream_sticky_halt(spark.readStream.schema(events.schema).parquet(f"{base}/in"), 2000.0)
        sb.run_available(stream, f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return out.select("account", "trade_date", "kind", fixed(F.col("equity"), 3).alias("equity"), fixed(F.col("peak"), 3).alias("peak"), "tripped")


@query("stream_record_upsert", f"""WITH {NET}, s AS (SELECT trade_date, count(*) AS trades, sum(net_pnl) AS net FROM net GROUP BY 1)
SELECT trade_date, CASE WHEN trade_date >= DATE '1999-01-01' THEN trades+1 ELSE trades END AS trades, CASE WHEN trade_date >= DATE '1999-01-01' THEN 2 ELSE 1 END AS written_at FROM s""")
def _(spark, sf):
    base = scratch(spark, "records")
    s = sessions(spark, sf).select("trade_date", "trades", F.lit(1).alias("written_at"))
    later = s.filter(F.col("trade_date") >= F.lit("1999-01-01").cast("date")).withColumns({"trades": F.col("trades") + 1, "written_at": F.lit(2)})
    sink = sinks.RecordSink(f"{base}/table")
    for part in (s, later):
        part.write.mode("append").parquet(f"{base}/in")
        sinks.run_batches(spark.readStream.schema(s.schema).parquet(f"{base}/in"), sink, f"{base}/checkpoint")
    return sink.read(spark)
