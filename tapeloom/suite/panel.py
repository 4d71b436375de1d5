"""Scans, sinks, row selection and calendars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.functions.frames import fixed
from tapeloom.operators import calendars as cal
from tapeloom.session import ensure_checkpoint_dir
from tapeloom.sources import archive, stores
from tapeloom.sources import tables as src
from tapeloom.sources.keyed import KeyedStore
from tapeloom.suite import sqlparts as q
from tapeloom.suite.register import query


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_bars", f"""WITH {q.WBARS}, r AS (SELECT * FROM wbars WHERE date >= DATE '1996-01-01' AND date <= DATE '2000-01-01')
SELECT symbol, date, close, volume FROM r QUALIFY count(*) OVER (PARTITION BY symbol) >= 165""")
def _(spark, sf):
    return stores.scan_bars(src.weekly_bars(spark, sf), "1996-01-01", "1999-12-31", 165).select(
        "symbol", "date", "close", "volume")


def _requested(spark, sf):
    return src.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"))


@query("scan_many_missing", """SELECT c_custkey AS symbol, c_custkey IN (SELECT l_suppkey FROM lineitem) AS found FROM customer""")
def _(spark, sf):
    return stores.scan_many_missing(_requested(spark, sf), src.weekly_bars(spark, sf))


@query("bar_coverage", f"""WITH {q.WBARS} SELECT c_custkey AS symbol, count(date)>0 AS cached, count(date) AS bars,
min(date) AS first, max(date) AS last FROM customer LEFT JOIN wbars ON symbol=c_custkey GROUP BY 1""")
def _(spark, sf):
    return stores.bar_coverage(_requested(spark, sf), src.weekly_bars(spark, sf))


def raw_archive(spark, sf):
    """The weekly bars as the three raw archive schemas: text fields with padding, blanks and unreadable numbers."""
    b = src.weekly_bars(spark, sf)
    text = {c: F.col(c).cast("decimal(20,4)").cast("string") for c in ("open", "high", "low", "close", "volume", "turnover")}
    text["open"] = F.when(F.col("volume") % 13 == 0, "n/a").otherwise(text["open"])
    text["close"] = F.when(F.col("volume") % 17 == 0, "-").when(F.col("volume") % 19 == 0, "NaN").when(F.col("volume") % 23 == 0, "Infinity").otherwise(text["close"])
    sym = F.concat(F.lit(" S"), F.col("symbol").cast("string"), F.lit(" "))
    ser = F.when(F.col("symbol") % 10 == 0, "BE ").otherwise(" EQ")
    key = (F.when(F.col("symbol") % 7 == 0, "  ").when(F.col("symbol") % 11 == 0, "SHORT")
           .otherwise(F.concat(F.lit("INE"), F.lpad(F.col("symbol").cast("string"), 9, "0"))))
    kind = F.when(F.col("volume") % 5 == 0, " IDX").otherwise("STK ")

    def shaped(rows, fields, extra):
        vals = {"symbol": sym, "series": ser, "prev_close": text["close"], **text}
        return rows.select("date", *[vals[d].alias(s) for s, d in fields.items()], *extra)

    d1, d2 = F.lit("1996-01-01").cast("date"), F.lit("1999-01-01").cast("date")
    old = shaped(b.filter(F.col("date") < d1), archive.LEGACY_FIELDS, [])
    mid = shaped(b.filter((F.col("date") >= d1) & (F.col("date") < d2)), archive.LEGACY_FIELDS, [key.alias("ISIN")])
    new = shaped(b.filter(F.col("date") >= d2), archive.CURRENT_FIELDS, [key.alias("ISIN"), kind.alias("FinInstrmTp")])
    return [old, mid], [new]


_RAW = q.WBARS + """, raw AS (SELECT date, CASE WHEN date < DATE '1996-01-01' THEN 1 WHEN date < DATE '1999-01-01' THEN 2 ELSE 3 END AS era,
 concat('S', symbol) AS sym, CASE WHEN symbol%10=0 THEN 'BE' ELSE 'EQ' END AS series,
 CASE WHEN symbol%7=0 THEN '' WHEN symbol%11=0 THEN 'SHORT' ELSE concat('INE', lpad(CAST(symbol AS VARCHAR), 9, '0')) END AS key,
 CAST(volume AS BIGINT)%5=0 AS idx, CASE WHEN CAST(volume AS BIGINT)%13=0 THEN 'n/a' ELSE CAST(CAST(open AS DECIMAL(20,4)) AS VARCHAR) END AS open,
 CASE WHEN CAST(volume AS BIGINT)%17=0 THEN '-' WHEN CAST(volume AS BIGINT)%19=0 THEN 'NaN' WHEN CAST(volume AS BIGINT)%23=0 THEN 'Infinity' ELSE CAST(CAST(close AS DECIMAL(20,4)) AS VARCHAR) END AS close,
 CAST(CAST(volume AS DECIMAL(20,4)) AS VARCHAR) AS volume FROM wbars),
norm AS (SELECT date, CASE WHEN era=1 THEN concat('SYM:', sym) WHEN era=2 THEN coalesce(nullif(key,''), concat('SYM:', sym)) ELSE key END AS isin,
 sym AS symbol, series, open, close, volume FROM raw WHERE NOT (era=3 AND idx)),
tidy AS (SELECT date, isin, symbol, series, TRY_CAST(open AS DOUBLE) AS open, TRY_CAST(close AS DOUBLE) AS close, TRY_CAST(volume AS DOUBLE) AS volume
 FROM norm WHERE (length(isin)=12 OR isin LIKE 'SYM:%') AND TRY_CAST(close AS DOUBLE) > 0 AND isfinite(TRY_CAST(close AS DOUBLE)))"""


@query("archive_normalise", f"WITH {_RAW} SELECT date, isin, symbol, series, open, close, volume FROM norm")
def _(spark, sf):
    return archive.archive_normalise(*raw_archive(spark, sf)).select("date", "isin", "symbol", "series", "open", "close", "volume")


def tidy(spark, sf):
    return archive.archive_tidy(archive.archive_normalise(*raw_archive(spark, sf)))


@query("archive_tidy", f"WITH {_RAW} SELECT date, isin, symbol, series, open, close, volume FROM tidy")
def _(spark, sf):
    return tidy(spark, sf).select("date", "isin", "symbol", "series", "open", "close", "volume")


@query("archive_range_scan", f"WITH {_RAW} SELECT date, isin, close FROM tidy WHERE date BETWEEN DATE '1997-03-01' AND DATE '1999-06-30'")
def _(spark, sf):
    path = scratch(spark, "archive")
    archive.write_archive(tidy(spark, sf), path)
    return archive.archive_range_scan(spark.read.parquet(path), "1997-03-01", "1999-06-30").select("date", "isin", "close")


@query("series_filter", f"WITH {_RAW} SELECT date, isin, close FROM tidy WHERE series='EQ'")
def _(spark, sf):
    return cal.series_filter(tidy(spark, sf)).select("date", "isin", "close")


def _order_span(spark, sf):
    return src.table(spark, sf, "orders").agg(F.min("o_orderdate").cast("date").alias("first"),
                                              F.max("o_orderdate").cast("date").alias("last"))


_WEEKDAYS = """days AS (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date FROM orders),
cal AS (SELECT date FROM days WHERE isodow(date) <= 5)"""


@query("weekday_calendar", f"WITH {_WEEKDAYS} SELECT date FROM cal")
def _(spark, sf):
    return archive.weekday_calendar(_order_span(spark, sf))


@query("archive_day_status", f"""WITH {_WEEKDAYS}, f AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n,
 count(*) FILTER (WHERE o_orderstatus='F') AS good FROM orders GROUP BY 1)
SELECT date, CASE WHEN n IS NULL THEN 'absent' WHEN good>0 THEN 'present' ELSE 'unreadable' END AS status, coalesce(good, 0) AS rows
FROM cal LEFT JOIN f USING (date)""")
def _(spark, sf):
    """Writes a file of every day with orders, the rows of open ones unreadable, and scans the files."""
    path = scratch(spark, "days")
    o = src.table(spark, sf, "orders")
    line = F.concat_ws(",", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).otherwise("no number"), "o_orderstatus")
    rows = o.select(line.alias("value"), F.date_format("o_orderdate", "yyyyMMdd").alias("day")).repartition("day")
    rows.write.partitionBy("day").text(path)
    schema = T.StructType([T.StructField("order_key", T.LongType()), T.StructField("status", T.StringType())])
    files = archive.scan_day_files(spark, f"{path}/*/*", schema, header=False)
    return archive.archive_day_status(archive.weekday_calendar(_order_span(spark, sf)), files)


@query("scan_json_store", f"WITH {q.FUNDAMENTALS} SELECT CAST(symbol AS VARCHAR) AS symbol, sector, price, market_cap_cr, age_days FROM fundamentals")
def _(spark, sf):
    """Writes the records as store files of 500 names each, one of them cut short, and scans them."""
    path = scratch(spark, "store")
    record = F.struct("sector", "price", "market_cap_cr", "age_days")
    files = src.fundamentals(spark, sf).groupBy(F.floor(F.col("symbol") / 500).alias("file")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("symbol").cast("string"), record))).alias("companies"))
    broken = files.select(F.lit('{"companies": {"0": {"sector"').alias("value")).limit(1)
    (files.select(F.to_json(F.struct("companies")).alias("value")).unionByName(broken).repartition("value")
     .write.option("maxRecordsPerFile", 1).text(path))
    schema = T.StructType([T.StructField("sector", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("market_cap_cr", T.DoubleType()),
                           T.StructField("age_days", T.LongType())])
    return stores.scan_json_store(spark, path, schema)


@query("explode_json_map", r"""SELECT event_id, regexp_extract(props, '"(\w+)"', 1) AS key, CAST(regexp_extract(props, ':\s*(-?\d+)', 1) AS BIGINT) AS value FROM events""")
def _(spark, sf):
    return stores.explode_json_map(src.table(spark, sf, "events").select("event_id", "props"), "props")


@query("scan_csv_records", f"WITH {q.TRADES} SELECT trade_id, trade_date, strategy, round(gross_pnl, 6) AS gross_pnl FROM trades")
def _(spark, sf):
    path = scratch(spark, "trades")
    src.trades(spark, sf).select("trade_id", "trade_date", "strategy", "gross_pnl").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("trade_id", T.LongType()), T.StructField("trade_date", T.DateType()),
                           T.StructField("strategy", T.StringType()), T.StructField("gross_pnl", T.DoubleType())])
    return stores.scan_csv_records(spark, path, schema).withColumn("gross_pnl", fixed(F.col("gross_pnl")))


@query("write_panel", f"WITH {q.WBARS} SELECT symbol, date, open, high, low, close, volume, round(turnover, 4) AS turnover, year(date) AS year FROM wbars")
def _(spark, sf):
    path = scratch(spark, "panel")
    stores.write_panel(src.weekly_bars(spark, sf), path)
    return spark.read.parquet(path).select("symbol", "date", "open", "high", "low", "close", "volume", fixed(F.col("turnover"), 4).alias("turnover"),
                                           F.col("year").cast("long").alias("year"))


@query("bucketed_panel", f"""WITH {q.PANEL} SELECT symbol, date, CASE WHEN count(*) OVER w>=20 THEN round(avg(close) OVER w, 6) END AS sma, round(close/lag(close) OVER o-1, 8) AS ret FROM panel
WINDOW o AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    """Windows by symbol on the bucketed layout: no shuffle after the one that wrote it."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    panel = stores.write_bucketed_panel(src.panel(spark, sf), name, scratch(spark, name), buckets)
    own = Window.partitionBy("symbol").orderBy("date")
    w = own.rowsBetween(-19, 0)
    return panel.select("symbol", "date", F.when(F.count(F.lit(1)).over(w) >= 20, fixed(F.avg("close").over(w))).alias("sma"),
                        fixed(F.col("close") / F.lag("close").over(own) - 1, 8).alias("ret"))


@query("write_reports", f"""WITH {q.TRADES}, r AS (SELECT reason, count(*) AS trades, round(sum(gross_pnl), 4) AS gross FROM trades GROUP BY 1)
SELECT 'json' AS kind, * FROM r UNION ALL SELECT 'csv', * FROM r""")
def _(spark, sf):
    path = scratch(spark, "reports")
    report = src.trades(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("trades"), fixed(F.sum("gross_pnl"), 4).alias("gross"))
    stores.write_reports({"by_reason": report}, path)
    as_json, as_csv = spark.read.schema(report.schema).json(f"{path}/by_reason.json"), stores.scan_csv_records(spark, f"{path}/by_reason.csv", report.schema)
    return as_json.select(F.lit("json").alias("kind"), "*").unionByName(as_csv.select(F.lit("csv").alias("kind"), "*"))


_DAYS = "SELECT CAST(o_orderdate AS DATE) AS trade_date, count(*) AS trades, {tag} AS origin FROM orders WHERE o_orderdate {cond} GROUP BY 1"


@query("upsert_by_date", f"""WITH s AS ({_DAYS.format(tag="'stored'", cond="< TIMESTAMP '2000-01-01'")}),
i AS ({_DAYS.format(tag="'incoming'", cond=">= TIMESTAMP '1998-06-01'")})
SELECT * FROM s WHERE trade_date NOT IN (SELECT trade_date FROM i) UNION ALL SELECT * FROM i""")
def _(spark, sf):
    def days(cond, tag):
        return (src.table(spark, sf, "orders").filter(cond).groupBy(F.col("o_orderdate").cast("date").alias("trade_date"))
                .agg(F.count(F.lit(1)).alias("trades")).withColumn("origin", F.lit(tag)))
    d = F.col("o_orderdate")
    return stores.upsert_by_date(days(d < F.lit("2000-01-01").cast("timestamp_ntz"), "stored"),
                                 days(d >= F.lit("1998-06-01").cast("timestamp_ntz"), "incoming"))


@query("upsert_by_range", f"""WITH {q.WBARS}, s AS (SELECT symbol, date, close, 'stored' AS origin FROM wbars WHERE date < DATE '2000-01-01'),
i AS (SELECT symbol, date, close, 'incoming' AS origin FROM wbars WHERE symbol%7=3 AND date >= DATE '1999-06-01')
SELECT * FROM s WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM i) UNION ALL SELECT * FROM i""")
def _(spark, sf):
    """Bars replaced by (symbol, date) in a keyed store, from folder to folder."""
    bars = src.weekly_bars(spark, sf).select("symbol", "date", "close")
    store = KeyedStore(scratch(spark, "keyed"), ("symbol", "date"), 32)
    store.upsert(bars.filter(F.col("date") < F.lit("2000-01-01").cast("date")).withColumn("origin", F.lit("stored")))
    store.upsert(bars.filter((F.col("symbol") % 7 == 3) & (F.col("date") >= F.lit("1999-06-01").cast("date"))).withColumn("origin", F.lit("incoming")))
    return store.read(spark)


@query("upsert_by_key", f"""WITH {q.FUNDAMENTALS}, i AS (SELECT concat('P', symbol+500) AS symbol, sector, price*2 AS price FROM fundamentals WHERE age_days IS NOT NULL),
s AS (SELECT concat('P', symbol) AS symbol, sector, price FROM fundamentals)
SELECT * FROM s WHERE symbol NOT IN (SELECT symbol FROM i) UNION ALL SELECT * FROM i""")
def _(spark, sf):
    f = src.fundamentals(spark, sf)
    name = F.concat(F.lit("P"), F.col("symbol").cast("string"))
    stored = f.select(name.alias("symbol"), "sector", "price")
    later = F.concat(F.lit("P"), (F.col("symbol") + 500).cast("string"))
    incoming = f.select(F.when(F.col("age_days").isNotNull(), later).otherwise(" ").alias("symbol"), "sector",
                        (F.col("price") * 2).alias("price"))
    return stores.upsert_by_key(stored, incoming)


@query("candidate_filter", """WITH l AS (SELECT c_custkey AS position, CASE WHEN c_nationkey%2=0 THEN ' nse ' ELSE 'BSE' END AS exch,
 CASE WHEN c_mktsegment='BUILDING' THEN 'D' ELSE 'e' END AS seg, CASE WHEN c_mktsegment='MACHINERY' THEN 'FUTSTK' ELSE 'Equity' END AS ins,
 CASE WHEN c_custkey%5=0 THEN 'BE' ELSE 'eq ' END AS ser, CAST(c_custkey//3 AS VARCHAR) AS security_id,
 CASE WHEN c_custkey%20=7 THEN concat('0', c_custkey, 'NSETEST') ELSE upper(replace(c_name, '#', '')) END AS symbol FROM customer),
p AS (SELECT * FROM l WHERE exch=' nse ' AND seg='e' AND ins='Equity' AND ser='eq '),
f AS (SELECT security_id, min_by(symbol, position) AS symbol FROM p GROUP BY 1)
SELECT security_id, symbol FROM f WHERE symbol NOT LIKE '%NSETEST%'""")
def _(spark, sf):
    c = src.table(spark, sf, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    listing = c.select(
        k.alias("position"), F.when(F.col("c_nationkey") % 2 == 0, " nse ").otherwise("BSE").alias("exchange"),
        F.when(seg == "BUILDING", "D").otherwise("e").alias("segment"),
        F.when(seg == "MACHINERY", "FUTSTK").otherwise("Equity").alias("instrument"),
        F.when(k % 5 == 0, "BE").otherwise("eq ").alias("series"),
        F.concat(F.floor(k / 3).cast("string"), F.lit(".0")).alias("security_id"),
        F.when(k % 20 == 7, F.concat(F.lit("0"), k.cast("string"), F.lit("NSETEST")))
        .otherwise(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("")))).alias("symbol"))
    return cal.candidate_filter(listing)


@query("dedupe_keep_last", """SELECT user_id, date_trunc('hour', ts) AS bar_ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC)=1""")
def _(spark, sf):
    e = src.table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar_ts"), "ts", "event_id", "value")
    return cal.dedupe_keep_last(e, ["user_id", "bar_ts"], ["ts", "event_id"]).drop("ts")


@query("session_index", f"WITH {q.PANEL} SELECT symbol, date, session_no FROM panel")
def _(spark, sf):
    return src.panel(spark, sf).select("symbol", "date", "session_no")


@query("panel_min_history", f"WITH {q.WBARS} SELECT symbol, date, close FROM wbars QUALIFY count(*) OVER (PARTITION BY symbol) >= 285")
def _(spark, sf):
    return cal.panel_min_history(src.weekly_bars(spark, sf), 285).select("symbol", "date", "close")


@query("live_session_filter", f"""WITH {q.WBARS} SELECT symbol, date, close FROM wbars
WHERE date IN (SELECT date FROM wbars GROUP BY date HAVING count(*) >= 0.8*(SELECT count(DISTINCT symbol) FROM wbars))""")
def _(spark, sf):
    return cal.live_session_filter(src.weekly_bars(spark, sf), 0.8).select("symbol", "date", "close")


@query("panel_slice", f"WITH {q.WBARS} SELECT symbol, date, open, close FROM wbars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'")
def _(spark, sf):
    return cal.panel_slice(src.weekly_bars(spark, sf), "1998-01-01", "1999-12-31").select("symbol", "date", "open", "close")


_GRID = "grid AS (SELECT symbol, date, session_no FROM (SELECT DISTINCT symbol FROM wbars) CROSS JOIN cal)"


@query("align_calendar", f"WITH {q.PANEL}, {_GRID} SELECT symbol, g.date, session_no, p.close FROM grid g LEFT JOIN panel p USING (symbol, session_no)")
def _(spark, sf):
    return cal.align_calendar(src.panel(spark, sf))


@query("mark_ffill", f"""WITH {q.PANEL}, {_GRID} SELECT symbol, session_no, p.close,
last_value(p.close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session_no) AS mark FROM grid g LEFT JOIN panel p USING (symbol, session_no)""")
def _(spark, sf):
    return cal.mark_ffill(cal.align_calendar(src.panel(spark, sf))).select("symbol", "session_no", "close", "mark")


@query("derive_turnover", f"WITH {q.WBARS} SELECT symbol, date, round(close*volume, 4) AS turnover FROM wbars")
def _(spark, sf):
    out = cal.derive_turnover(src.weekly_bars(spark, sf))
    return out.select("symbol", "date", fixed(F.col("turnover"), 4).alias("turnover"))


SESSION = ("06:00", "22:00", 10)
HSESS = q.HBARS + """, sess AS (SELECT * FROM hbars WHERE strftime(bar_ts, '%H:%M') BETWEEN '06:00' AND '22:00'
 QUALIFY count(*) OVER (PARTITION BY symbol, trade_date) >= 10)"""


@query("session_split", f"WITH {HSESS} SELECT symbol, trade_date, bar_ts, close FROM sess")
def _(spark, sf):
    return cal.session_split(src.hourly_bars(spark, sf), *SESSION).select("symbol", "trade_date", "bar_ts", "close")


@query("session_dates", f"WITH {HSESS} SELECT DISTINCT trade_date FROM sess")
def _(spark, sf):
    return cal.session_dates(cal.session_split(src.hourly_bars(spark, sf), *SESSION))


@query("confirmed_bars", f"WITH {q.HBARS} SELECT symbol, bar_ts, close FROM hbars WHERE bar_ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(spark, sf):
    now = src.table(spark, sf, "events").select(F.max("ts"))
    return cal.confirmed_bars(src.hourly_bars(spark, sf), now.scalar()).select("symbol", "bar_ts", "close")


@query("round_tick", f"WITH {q.TRADES} SELECT trade_id, round(round_even(entry_price/0.05, 0)*0.05, 2) AS price FROM trades")
def _(spark, sf):
    return src.trades(spark, sf).select("trade_id", cal.round_tick(F.col("entry_price")).alias("price"))
