"""Data-quality audits on records, logs and sidecars derived from the tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.operators import audits as ad
from tapeloom.session import scratch, settled_apart, shuffles_dropped
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.register import ORACLE, QUERIES, query


def sidecars(spark, sf):
    """One JSON sidecar per customer, its series ending at the customer's last order."""
    o = src.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("last"))
    end = src.table(spark, sf, "orders").select(F.max("o_orderdate").cast("date"))
    k = F.col("c_custkey")
    warns = F.array_compact(F.array(
        F.when(k % 5 == 0, F.concat(F.lit("Zero volume on "), (k % 40).cast("string"), F.lit(" bars"))), F.when(k % 7 == 0, F.lit("2 gaps longer than 10 days")),
        F.when(k % 11 == 0, F.lit("incoherent bars widened")), F.when(k % 13 == 0, F.lit("duplicate stamps")), F.when(k % 17 == 0, F.lit("odd tick"))))
    doc = F.struct(
        F.concat(F.lit("C"), k.cast("string")).alias("symbol"), F.when(F.col("c_nationkey") % 4 == 0, "BSE_FNO").otherwise("NSE_EQ").alias("segment"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "INDEX").otherwise("EQUITY").alias("instrument_type"), F.when(k % 3 == 0, "5").otherwise("D").alias("timeframe"),
        F.struct(warns.alias("warnings"), F.when(k % 29 == 0, F.array(F.lit("no bars"))).otherwise(F.array().cast("array<string>")).alias("hard_failures"),
                 F.col("last").cast("string").alias("last")).alias("audit"), F.struct(end.scalar().cast("string").alias("end")).alias("fetch_range"))
    texts = src.table(spark, sf, "customer").join(o, "c_custkey").select(F.to_json(doc).alias("text"))
    return ad.parse_sidecars(texts, "text")


SIDE = """lo AS (SELECT o_custkey AS k, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1), en AS (SELECT CAST(max(o_orderdate) AS DATE) AS e FROM orders),
sc AS (SELECT k, concat('C', k) AS symbol, last, e, CASE WHEN k%3=0 THEN '5' ELSE 'D' END AS tf FROM customer JOIN lo ON k=c_custkey, en WHERE c_nationkey%4<>0 AND c_mktsegment<>'MACHINERY')"""


@query("audit_sidecars", f"""WITH {SIDE}, w AS (SELECT symbol, 'zero_volume' AS kind FROM sc WHERE k%5=0 UNION ALL SELECT symbol, 'history_gaps' FROM sc WHERE k%7=0 UNION ALL SELECT symbol, 'repaired_bars' FROM sc WHERE k%11=0
 UNION ALL SELECT symbol, 'duplicate_bars' FROM sc WHERE k%13=0 UNION ALL SELECT symbol, 'other' FROM sc WHERE k%17=0 UNION ALL SELECT symbol, 'hard_failure' FROM sc WHERE k%29=0)
SELECT kind, count(DISTINCT symbol) AS series, count(*) AS warnings FROM w WHERE symbol IN (SELECT concat('C', o_custkey) FROM orders WHERE o_orderstatus='P') GROUP BY 1""")
def _(spark, sf):
    uni = src.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"))
    return ad.audit_sidecars(sidecars(spark, sf), uni)


def _today(spark, sf):
    return src.table(spark, sf, "orders").select(F.max("o_orderdate").cast("date")).scalar()


@query("stale_series", f"WITH {SIDE} SELECT symbol, e-last AS age_days FROM sc WHERE tf='D' AND e-last>5")
def _(spark, sf):
    return ad.stale_series(sidecars(spark, sf), _today(spark, sf))


@query("coverage_gaps", f"WITH {SIDE} SELECT symbol, e-last AS gap_days, last AS ends FROM sc WHERE e-last>10")
def _(spark, sf):
    return ad.coverage_gaps(sidecars(spark, sf))


@query("worst_gap", f"WITH {SIDE} SELECT count(*) AS series, CAST(sum(e-last) AS BIGINT) AS days, max(e-last) AS worst_days, max_by(symbol, (e-last, symbol)) AS worst FROM sc WHERE e-last>10")
def _(spark, sf):
    return ad.worst_gap(ad.coverage_gaps(sidecars(spark, sf)))


CAUSES = q.LOGS + r""", pl AS (SELECT line FROM logs WHERE line LIKE '% ERROR %' OR line LIKE '% WARNING %'),
cz AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(line, '0x[0-9A-Fa-f]+', '<addr>', 'g'), '\d{4}-\d{2}-\d{2}', '<date>', 'g'), '\d+', 'N', 'g')) AS cause, count(*) AS lines FROM pl GROUP BY 1)"""


@query("log_cause_groups", f"""WITH {CAUSES} SELECT cause, substr(cause, 1, 160) AS label, lines, CASE WHEN cause LIKE '%getaddrinfo%' OR cause LIKE '%Max retries exceeded%' OR cause LIKE '%Connection aborted%' THEN 'network' WHEN cause LIKE '%DH-N%' THEN 'vendor' ELSE 'other' END AS bucket FROM cz""")
def _(spark, sf):
    return ad.log_cause_groups(src.log_lines(spark, sf))


@query("repeat_failures", f"""WITH {CAUSES}, s AS (SELECT regexp_extract(line, '(?:WARNING|ERROR)\\s+([A-Z][A-Z0-9&\\-]*)\\s+(?:D|\\d+m)\\b', 1) AS symbol FROM pl WHERE line NOT LIKE '%2024-01-06..2024-01-07%')
SELECT symbol, count(*) AS failures FROM s WHERE symbol<>'' GROUP BY 1 HAVING count(*)>=3""")
def _(spark, sf):
    return ad.repeat_failures(src.log_lines(spark, sf))


def failures(spark, sf):
    e = src.table(spark, sf, "events").filter(F.col("event_type") == "error")
    reason = F.concat(F.lit("no data for kind "), (F.col("user_id") % 4).cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Chunk errors: "), F.col("props"))).otherwise(""))
    return e.select(F.col("event_id").alias("symbol"), reason.alias("reason"))


@query("failure_reasons", "SELECT event_id AS symbol, concat('no data for kind ', user_id%4) AS cause, count(*) OVER (PARTITION BY user_id%4) AS symbols FROM events WHERE event_type='error'")
def _(spark, sf):
    return ad.failure_reasons(failures(spark, sf))


@query("universe_staleness", f"WITH {q.WBARS} SELECT max(date) AS as_of, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)-max(date) AS age_days, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)-max(date)>3 AS stale FROM wbars")
def _(spark, sf):
    return ad.universe_staleness(src.weekly_bars(spark, sf), _today(spark, sf))


def requested(spark, sf):
    return src.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"))


def records(spark, sf):
    """Fundamentals of two thirds of the parts, so that requested keys can be missing."""
    return src.fundamentals(spark, sf).withColumn("symbol", F.col("symbol") + F.floor(F.col("symbol") / 2).cast("long"))


RECS = q.FUNDAMENTALS + ", recs AS (SELECT symbol + symbol//2 AS symbol, sector, category, price, market_cap_cr, age_days FROM fundamentals)"


@query("fundamentals_coverage", f"""WITH {RECS} SELECT count(*) AS requested, count(r.symbol) AS covered, count(*) FILTER (WHERE age_days<=30) AS fresh, count(*) FILTER (WHERE r.symbol IS NOT NULL AND coalesce(age_days>30, true)) AS stale,
count(*) FILTER (WHERE r.symbol IS NULL) AS missing, median(age_days) AS median_age_days FROM customer LEFT JOIN recs r ON r.symbol=c_custkey""")
def _(spark, sf):
    return ad.fundamentals_coverage(requested(spark, sf), records(spark, sf))


@query("fundamentals_join", f"""WITH {RECS} SELECT c_custkey AS symbol, c_acctbal, sector, age_days, CASE WHEN r.symbol IS NOT NULL THEN coalesce(age_days>30, true) END AS stale FROM customer LEFT JOIN recs r ON r.symbol=c_custkey""")
def _(spark, sf):
    f = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), "c_acctbal")
    return ad.fundamentals_join(f, records(spark, sf)).select("symbol", "c_acctbal", "sector", "age_days", "stale")


@query("implied_share_check", f"WITH {q.FUNDAMENTALS} SELECT symbol, round(market_cap_cr*1e7/price, 2) AS implied_shares FROM fundamentals WHERE market_cap_cr IS NOT NULL AND NOT (market_cap_cr*1e7/price BETWEEN 5e5 AND 5e10)")
def _(spark, sf):
    return ad.implied_share_check(src.fundamentals(spark, sf)).select("symbol", fixed(F.col("implied_shares"), 2).alias("implied_shares"))


FIND = CAUSES + ", " + SIDE + ", " + RECS


@query("findings_report", f"""WITH {FIND}, s AS (SELECT count(*) AS n, max(e-last) AS w FROM sc WHERE tf='D' AND e-last>5), g AS (SELECT count(*) AS n, max(e-last) AS w FROM sc WHERE e-last>10),
nw AS (SELECT sum(lines) AS n FROM cz WHERE cause LIKE '%getaddrinfo%'), vd AS (SELECT sum(lines) AS n FROM cz WHERE cause LIKE '%DH-N%' AND cause NOT LIKE '%getaddrinfo%'),
fc AS (SELECT count(*) AS q, count(r.symbol) AS c FROM customer LEFT JOIN recs r ON r.symbol=c_custkey)
SELECT CASE WHEN w>14 THEN 'critical' ELSE 'warning' END AS severity, 'cache' AS area, concat(n, ' daily series are stale, worst ', w, ' days') AS title, n AS count FROM s
UNION ALL SELECT CASE WHEN n>0 THEN 'critical' ELSE 'info' END, 'coverage', concat(n, ' series claim coverage they do not hold'), n FROM g
UNION ALL SELECT CASE WHEN n>200 THEN 'critical' ELSE 'warning' END, 'network', concat(CAST(n AS BIGINT), ' lines from lost connectivity'), CAST(n AS BIGINT) FROM nw
UNION ALL SELECT 'warning', 'vendor', concat(CAST(n AS BIGINT), ' lines refused by the vendor'), CAST(n AS BIGINT) FROM vd
UNION ALL SELECT CASE WHEN c>=0.9*q THEN 'info' ELSE 'warning' END, 'fundamentals', concat(c, '/', q, ' names have fundamentals'), c FROM fc""")
def _(spark, sf):
    side = sidecars(spark, sf)
    st = ad.stale_series(side, _today(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.max("age_days").alias("w"))
    gp = ad.worst_gap(ad.coverage_gaps(side))
    lg = ad.log_cause_groups(src.log_lines(spark, sf)).agg(*[F.sum(F.when(F.col("bucket") == b, F.col("lines"))).alias(b) for b in ("network", "vendor")])
    fc = ad.fundamentals_coverage(requested(spark, sf), records(spark, sf))
    return ad.findings_report([
        ad.finding(st, F.when(F.col("w") > ad.WORST_STALE_DAYS, ad.CRITICAL).otherwise(ad.WARN), "cache", F.format_string("%d daily series are stale, worst %d days", "n", "w"), F.col("n")),
        ad.finding(gp, F.when(F.col("series") > 0, ad.CRITICAL).otherwise(ad.INFO), "coverage", F.format_string("%d series claim coverage they do not hold", "series"), F.col("series")),
        ad.finding(lg, F.when(F.col("network") > 200, ad.CRITICAL).otherwise(ad.WARN), "network", F.format_string("%d lines from lost connectivity", "network"), F.col("network")),
        ad.finding(lg, ad.WARN, "vendor", F.format_string("%d lines refused by the vendor", "vendor"), F.col("vendor")),
        ad.finding(fc, F.when(F.col("covered") >= 0.9 * F.col("requested"), ad.INFO).otherwise(ad.WARN), "fundamentals", F.format_string("%d/%d names have fundamentals", "covered", "requested"), F.col("covered")),
    ]).drop("severity_order")


#: Queries whose rows depend on the bars up to their date only; each is run on the whole and on the cut tables.
CAUSAL = ("sma", "true_range", "atr_wilder", "ema", "rolling_slope_r2", "rolling_median_turnover", "max_abs_gap", "efficiency_ratio", "rolling_percentile", "efficiency_percentile",
          "momentum_12_1", "horizon_returns", "range_gap_pct", "liquidity_factors", "compute_factors", "eligibility", "rank_top_n", "winsorised_z", "clenow_ranking", "atr_stop_levels",
          "drawdown_curve", "breadth", "regime_table", "select_universe_by_regime")
BY_DATE = ("rank_top_n", "winsorised_z", "clenow_ranking", "breadth", "regime_table", "select_universe_by_regime")
CUT = "1998-06-01"
#: Queries at a time, and the ticks of one part of the series and of one bucket of them.
THREADS = 3
SLICE_TICKS, BUCKET_TICKS = 1 << 23, 1 << 19


def _invariance_sql():
    short = f"FROM (SELECT * FROM lineitem WHERE CAST(date_trunc('week', l_shipdate) AS DATE) <= DATE '{CUT}')"
    parts = []
    for name in CAUSAL:
        early = f"date <= DATE '{CUT}'" if name in BY_DATE else f"session_no <= (SELECT count(DISTINCT date_trunc('week', l_shipdate)) {short})"
        full, part = f"(SELECT * FROM ({ORACLE[name]}) WHERE {early})", f"(SELECT * FROM ({ORACLE[name].replace('FROM lineitem', short)}))"
        parts.append(f"SELECT '{name}' AS op, count(*) AS mismatches FROM (({full} EXCEPT ALL {part}) UNION ALL ({part} EXCEPT ALL {full}))")
    return " UNION ALL ".join(parts)


@query("truncation_invariance", _invariance_sql())
def _(spark, sf):
    """Mismatch counts of the windowed queries when the tables end earlier; all zero.

    Both panels are stored once for all queries, the cut ticks are not. A series' rows depend on this series alone in all
    queries but those by date, so these run on one part of the series after another and their mismatches add up; a query
    by date runs on all series, the whole history and the cut one in turn, and only the two results are kept to be
    compared. So the disk holds the panels and the shuffles of a few parts, or of one query by date. The queries by
    series are driven from a few threads, so that the short stages of one fill the cores that another leaves idle.
    """
    cut, short = F.lit(CUT).cast("date"), f"{sf}/cut"
    ticks = src.table(spark, sf, "lineitem")
    rows = ticks.count()
    slices, buckets = -(-max(rows, 1) // SLICE_TICKS), max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_TICKS))

    def by_series(name, part):
        with src.one_slice(part):
            return ad.truncation_mismatches(QUERIES[name](spark, sf), QUERIES[name](spark, short), F.col("session_no") <= sessions).first()[0]

    def by_date(name):
        with scratch(spark) as path:
            sides = []
            for folder, kept in ((sf, f"{path}/full"), (short, f"{path}/part")):
                with settled_apart(spark):
                    found = QUERIES[name](spark, folder)
                    (found.filter(F.col("date") <= cut) if folder == sf else found).write.option("compression", "zstd").parquet(kept)
                sides.append(spark.read.schema(found.schema).parquet(kept))
            return ad.truncation_mismatches(*sides, F.col("date") <= cut).first()[0]

    with src.given_table(short, "lineitem", ticks.filter(F.date_trunc("week", "l_shipdate").cast("date") <= cut)), shuffles_dropped(spark):
        sessions = src.table(spark, short, "lineitem").select(F.countDistinct(F.date_trunc("week", "l_shipdate"))).first()[0]
        with src.sliced_panel(spark, sf, slices, buckets), src.sliced_panel(spark, short, slices, buckets):
            counts = dict.fromkeys(CAUSAL, 0)
            with ThreadPoolExecutor(THREADS) as pool:
                runs = [(name, pool.submit(copy_context().run, by_series, name, part)) for name in CAUSAL if name not in BY_DATE for part in range(slices)]
                for name, run in runs:
                    counts[name] += run.result()
            for name in CAUSAL:
                if name in BY_DATE:
                    counts[name] = by_date(name)
    return spark.createDataFrame(list(counts.items()), "op string, mismatches long")
