"""Data-quality audits: sidecars, staleness, coverage, run logs, fundamentals, causality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Audit thresholds, severities and the marks that sort log lines.
STALE_DAYS, WORST_STALE_DAYS, COVERAGE_GAP_DAYS, STALE_UNIVERSE_DAYS, STALE_RECORD_DAYS = 5, 14, 10, 3, 30
CRORE = 1e7
SHARES_LOW, SHARES_HIGH = 5e5, 5e10
CRITICAL, WARN, INFO = "critical", "warning", "info"
SEVERITY_ORDER = {CRITICAL: 0, WARN: 1, INFO: 2}
NETWORK_MARKS = ("getaddrinfo", "Max retries exceeded", "Connection aborted")
VENDOR_MARK = "DH-N"
LABEL_LENGTH = 160

SIDECAR = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("instrument_type", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("audit", T.StructType([T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("hard_failures", T.ArrayType(T.StringType())),
                                         T.StructField("last", T.StringType())])),
    T.StructField("fetch_range", T.StructType([T.StructField("end", T.StringType())]))])


def parse_sidecars(texts: DataFrame, text: str) -> DataFrame:
    """Sidecar JSON documents to nested rows; documents that do not parse are left out."""
    parsed = texts.select(F.from_json(F.col(text), SIDECAR).alias("s")).select("s.*")
    return parsed.filter(F.col("symbol").isNotNull())


def traded(sidecars: DataFrame, segment: str = "NSE_EQ", instrument: str = "EQUITY") -> DataFrame:
    return sidecars.filter((F.col("segment") == segment) & (F.col("instrument_type") == instrument))


def warning_kind(text: Column) -> Column:
    # Wording of the warnings.
    t = F.lower(text)
    return (F.when(t.contains("zero volume"), "zero_volume").when(t.contains("gaps longer than"), "history_gaps")
            .when(t.contains("incoherent"), "repaired_bars").when(t.contains("duplicate"), "duplicate_bars").otherwise("other"))


def audit_sidecars(sidecars: DataFrame, universe: DataFrame) -> DataFrame:
    """Series of the universe per warning kind, hard failures as their own kind."""
    rows = traded(sidecars).join(universe.select("symbol").distinct(), "symbol", "left_semi")
    name = F.concat_ws("/", "symbol", "timeframe")
    warn = rows.select(name.alias("series"), F.explode("audit.warnings").alias("w")).select("series", warning_kind(F.col("w")).alias("kind"))
    hard = rows.filter(F.size("audit.hard_failures") > 0).select(name.alias("series"), F.lit("hard_failure").alias("kind"))
    return warn.unionByName(hard).groupBy("kind").agg(F.countDistinct("series").alias("series"), F.count(F.lit(1)).alias("warnings"))


def stale_series(sidecars: DataFrame, as_of: Column, limit: int = STALE_DAYS) -> DataFrame:
    """Daily series whose last bar is more than ``limit`` days old."""
    age = F.datediff(as_of, F.to_date("audit.last"))
    return traded(sidecars).filter(F.col("timeframe") == "D").select("symbol", age.cast("long").alias("age_days")).filter(F.col("age_days") > limit)


def coverage_gaps(sidecars: DataFrame, limit: int = COVERAGE_GAP_DAYS) -> DataFrame:
    """Series that claim a later end than they hold."""
    gap = F.datediff(F.to_date("fetch_range.end"), F.to_date("audit.last")).cast("long")
    return traded(sidecars).select("symbol", gap.alias("gap_days"), F.to_date("audit.last").alias("ends")).filter(F.col("gap_days") > limit)


def worst_gap(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count(F.lit(1)).alias("series"), F.sum("gap_days").alias("days"), F.max("gap_days").alias("worst_days"),
                    F.max_by("symbol", F.struct("gap_days", "symbol")).alias("worst"))


def problem_lines(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("line").contains(" ERROR ") | F.col("line").contains(" WARNING "))


def log_cause(line: Column) -> Column:
    """The whole line with addresses, dates and numbers collapsed."""
    s = F.regexp_replace(line, r"0x[0-9A-Fa-f]+", "<addr>")
    s = F.regexp_replace(s, r"\d{4}-\d{2}-\d{2}", "<date>")
    return F.trim(F.regexp_replace(s, r"\d+", "N"))


def log_cause_groups(logs: DataFrame) -> DataFrame:
    """Lines per cause with its bucket (lost network, vendor refusal, other) and a label of 160 characters."""
    g = problem_lines(logs).groupBy(log_cause(F.col("line")).alias("cause")).agg(F.count(F.lit(1)).alias("lines"))
    net = F.lit(False)
    for m in NETWORK_MARKS:
        net = net | F.col("cause").contains(m)
    vendor = F.col("cause").contains(VENDOR_MARK) & ~F.col("cause").contains("getaddrinfo")
    return g.withColumns({"label": F.substring("cause", 1, LABEL_LENGTH), "bucket": F.when(net, "network").when(vendor, "vendor").otherwise("other")})


def range_had_sessions(line: Column) -> Column:
    """Whether the date range in the line holds a weekday; true without a readable range."""
    pat = r"(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})"
    a, b = (F.try_to_timestamp(F.nullif(F.regexp_extract(line, pat, i), F.lit(""))).cast("date") for i in (1, 2))
    days = F.datediff(b, a)
    some = F.exists(F.sequence(F.lit(0), F.least(days, F.lit(6))), lambda k: F.weekday(F.date_add(a, k)) < 5)
    return F.when(a.isNull() | b.isNull(), True).when(days < 0, False).otherwise(some)


def repeat_failures(logs: DataFrame, least: int = 3) -> DataFrame:
    """Symbols failing at least ``least`` times on ranges that could hold a session."""
    # Fixed value: where a failure line names its symbol.
    sym = F.regexp_extract("line", r"(?:WARNING|ERROR)\s+([A-Z][A-Z0-9&\-]*)\s+(?:D|\d+m)\b", 1)
    rows = problem_lines(logs).select(sym.alias("symbol"), "line").filter((F.col("symbol") != "") & range_had_sessions(F.col("line")))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= least)


def failure_reasons(failures: DataFrame) -> DataFrame:
    """One row per failed symbol with the message prefix it shares and how many symbols share it.

    Kept long, so one reason held by a third of all symbols never becomes one array.
    """
    key = F.trim(F.split("reason", " Chunk errors:")[0])
    rows = failures.select("symbol", key.alias("cause"))
    return rows.join(rows.groupBy("cause").agg(F.count(F.lit(1)).alias("symbols")), "cause")


def universe_staleness(universe: DataFrame, today: Column, limit: int = STALE_UNIVERSE_DAYS) -> DataFrame:
    return universe.agg(F.max("date").alias("as_of")).select(
        "as_of", F.datediff(today, F.col("as_of")).cast("long").alias("age_days"), (F.datediff(today, F.col("as_of")) > limit).alias("stale"))


def finding(df: DataFrame, severity: Column | str, area: str, title: Column, count: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(sev.alias("severity"), F.lit(area).alias("area"), title.alias("title"), count.cast("long").alias("count"))


def findings_report(findings: Sequence[DataFrame]) -> DataFrame:
    """All findings, severity order first, then count; ``position`` keeps the order in a table."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    order = F.lit(len(SEVERITY_ORDER))
    for s, n in SEVERITY_ORDER.items():
        order = F.when(F.col("severity") == s, n).otherwise(order)
    return out.withColumn("severity_order", order).orderBy("severity_order", F.col("count").desc(), "area")


def with_age(records: DataFrame, limit: int = STALE_RECORD_DAYS) -> DataFrame:
    return records.withColumn("stale", F.coalesce(F.col("age_days") > limit, F.lit(True)))


def fundamentals_join(factors: DataFrame, records: DataFrame, limit: int = STALE_RECORD_DAYS) -> DataFrame:
    """Factor rows with sector, size and whether the record is stale (also when its age is unknown)."""
    return factors.join(with_age(records, limit), "symbol", "left")


def fundamentals_coverage(requested: DataFrame, records: DataFrame, limit: int = STALE_RECORD_DAYS) -> DataFrame:
    """Ages are whole days, so the exact median's state is bounded by the distinct ages."""
    have = with_age(records, limit).select("symbol", "age_days", "stale", F.lit(1).alias("_have"))
    j = requested.select("symbol").distinct().join(have, "symbol", "left")
    return j.agg(F.count(F.lit(1)).alias("requested"), F.count("_have").alias("covered"), F.count_if(~F.col("stale")).alias("fresh"),
                 F.count_if(F.col("stale")).alias("stale"), F.count_if(F.col("_have").isNull()).alias("missing"), F.percentile("age_days", 0.5).alias("median_age_days"))


def implied_share_check(records: DataFrame) -> DataFrame:
    """Records whose market value implies an implausible number of shares at the price."""
    shares = F.col("market_cap_cr") * CRORE / F.nullif(F.col("price"), F.lit(0.0))
    return records.withColumn("implied_shares", shares).filter(shares.isNotNull() & ~shares.between(SHARES_LOW, SHARES_HIGH))


def truncation_invariance(op: Callable[[DataFrame], DataFrame], rows: DataFrame, cut: Column, keys: Sequence[str]) -> DataFrame:
    """Rows at or before ``cut`` that differ when the operator only sees history up to it; zero for a causal operator."""
    return truncation_mismatches(op(rows), op(rows.filter(F.col("date") <= cut)), F.col("date") <= cut)


def truncation_mismatches(full: DataFrame, part: DataFrame, early: Column) -> DataFrame:
    """``early`` rows in which a result on the whole history and one on the cut history differ, each way.

    Each result is read once: equal rows of both sides meet in one group, and what one side has more of them is a mismatch.
    """
    cols = full.columns
    sides = full.filter(early).withColumn("_side", F.lit(1)).unionByName(part.withColumn("_side", F.lit(-1)))
    surplus = sides.groupBy(*cols).agg(F.sum("_side").alias("_surplus"))
    return surplus.agg(F.coalesce(F.sum(F.abs("_surplus")), F.lit(0)).alias("mismatches"))
