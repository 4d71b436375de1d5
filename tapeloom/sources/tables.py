"""Bars, ticks, trades and reference data derived from the given parquet tables.

Bars are hash-aggregated with ordered ``min_by``/``max_by``: the partial aggregate runs before the shuffle, so a
symbol that holds a third of all ticks sends at most one row per bar and map task.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.frames import cleaned
from tapeloom.session import scratch, stored

#: Stored panels by folder, seen only by the code that runs in the block that stored them.
_SHARED: ContextVar[dict[str, DataFrame]] = ContextVar("shared panels", default={})
#: Tables by folder and name that stand for files, seen likewise.
_GIVEN: ContextVar[dict[tuple[str, str], DataFrame]] = ContextVar("given tables", default={})
#: The part of the series that a row of a stored panel belongs to.
SLICE = "_slice"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    given = _GIVEN.get().get((sf_dir, name))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet") if given is None else given


@contextlib.contextmanager
def given_table(sf_dir: str, name: str, rows: DataFrame) -> Iterator[None]:
    """While the block runs, ``rows`` are the table ``name`` of the folder, which need not exist: no copy is written."""
    before = _GIVEN.set({**_GIVEN.get(), (sf_dir, name): rows})
    try:
        yield
    finally:
        _GIVEN.reset(before)


def bars_from_ticks(ticks: DataFrame, keys: Sequence[str], order: Sequence[str], price: str,
                    extra: Sequence[Column] = ()) -> DataFrame:
    """Open, high, low, close of ``price`` per key; ``order`` must be a total order of the ticks."""
    first = F.struct(*[F.col(c) for c in order])
    return ticks.groupBy(*keys).agg(
        F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, first).alias("close"), *extra)


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier; price is 100·ln(unit price), kept as integer ticks until the last step."""
    items = cleaned(table(spark, sf_dir, "lineitem")).filter("l_extendedprice > 0 AND l_quantity > 0")
    ticks = items.select(
        F.col("l_suppkey").alias("symbol"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        F.round(F.lit(1e6) * F.log(F.col("l_extendedprice") / F.col("l_quantity"))).cast("long").alias("tick"),
        F.col("l_quantity").cast("long").alias("qty"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    bars = bars_from_ticks(
        ticks, ["symbol", "date"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], "tick",
        [F.sum("qty").alias("volume"), F.sum(F.col("qty") * F.col("tick")).alias("turnover")])
    scale = F.lit(1e4)
    return bars.select("symbol", "date", *[(F.col(c) / scale).alias(c) for c in ("open", "high", "low", "close")],
                       F.col("volume").cast("double").alias("volume"),
                       (F.col("turnover") / scale).alias("turnover"))


def with_sessions(bars: DataFrame, date: str = "date", days: DataFrame | None = None) -> DataFrame:
    """Attach the dense session number of the shared calendar.

    The calendar is one row per distinct date: its size is bounded by the days the data span, never by the bars,
    which is what makes the single-partition ranking and the broadcast safe. ``days`` may give the dates from a
    cheaper source than the finished bars.
    """
    calendar = (bars.select(date) if days is None else days).distinct()
    calendar = calendar.withColumn("session_no", F.dense_rank().over(Window.orderBy(date)).cast("int"))
    return bars.join(F.broadcast(calendar), date)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with session numbers; the calendar reads only the date column of the ticks."""
    if sf_dir in _SHARED.get():
        return _SHARED.get()[sf_dir].drop(SLICE)
    days = table(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    return with_sessions(weekly_bars(spark, sf_dir), days=days)


@contextlib.contextmanager
def shared_panel(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """While the block runs, every ``panel`` of the folder reads one stored copy; for audits that run many queries on it."""
    with stored(panel(spark, sf_dir)) as kept:
        before = _SHARED.set({**_SHARED.get(), sf_dir: kept})
        try:
            yield
        finally:
            _SHARED.reset(before)


@contextlib.contextmanager
def sliced_panel(spark: SparkSession, sf_dir: str, slices: int, buckets: int) -> Iterator[None]:
    """As ``shared_panel``, the copy dealt into ``slices`` parts of the series and ``buckets`` buckets by series.

    Each part is built on its own, so the shuffles of the ticks hold one part, and windows by series read the buckets
    without a shuffle. ``one_slice`` lets queries see one part.
    """
    rows = panel(spark, sf_dir).withColumn(SLICE, F.pmod(F.xxhash64("symbol"), F.lit(slices)).cast("int"))
    name = f"panel_{uuid.uuid4().hex}"
    with scratch(spark) as path:
        try:
            for part in range(slices):
                (rows.filter(F.col(SLICE) == part).repartition(buckets, "symbol").write.mode("append").partitionBy(SLICE)
                 .bucketBy(buckets, "symbol").sortBy("symbol", "session_no").option("path", path).option("compression", "zstd").saveAsTable(name))
            before = _SHARED.set({**_SHARED.get(), sf_dir: spark.table(name)})
            try:
                yield
            finally:
                _SHARED.reset(before)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextlib.contextmanager
def one_slice(part: int) -> Iterator[None]:
    """While the block runs, every sliced panel is the one part of its series; session numbers stay those of the whole."""
    before = _SHARED.set({sf: rows.filter(F.col(SLICE) == part) if SLICE in rows.columns else rows for sf, rows in _SHARED.get().items()})
    try:
        yield
    finally:
        _SHARED.reset(before)


def benchmark(bars: DataFrame) -> DataFrame:
    """Equal-weight index bars: mean close, high and low of the names that printed, one row per session."""
    return bars.groupBy("date", "session_no").agg(
        F.avg("close").alias("close"), F.avg("high").alias("high"), F.avg("low").alias("low"))


def hourly_bars(spark: SparkSession, sf_dir: str, level: float = 500.0) -> DataFrame:
    """Hourly bars from event ticks, symbol = user_id % 5; the event value is a move around a price level."""
    ticks = cleaned(table(spark, sf_dir, "events")).filter("value IS NOT NULL").select(
        (F.col("user_id") % 5).alias("symbol"), F.col("ts").cast("date").alias("trade_date"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar_ts"), (F.col("value") + level).alias("px"), "ts", "event_id")
    bars = bars_from_ticks(ticks, ["symbol", "trade_date", "bar_ts"], ["ts", "event_id"], "px",
                           [F.count(F.lit(1)).cast("double").alias("volume")])
    return bars


def identity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, isin, date) observations; chains of customers share a key before 1998."""
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"),
                 F.col("o_custkey") - F.col("o_custkey") % 3).otherwise(F.col("o_custkey"))
    return o.select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("symbol"),
                    F.concat(F.lit("I"), key.cast("string")).alias("isin"),
                    F.col("o_orderdate").cast("date").alias("date"))


def action_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate-action texts on weekly sessions, symbol on the supplier keys of the weekly bars."""
    o = table(spark, sf_dir, "orders")
    c, k, p = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority")
    subject = (F.when(p == "1-URGENT", F.concat(F.lit("Bonus "), (1 + c % 4).cast("string"), F.lit(":"),
                                                (1 + k % 3).cast("string")))
               .when(p == "2-HIGH", F.lit("Fv Split-Rs.10/-To Rs.2/-"))
               .when(p == "3-MEDIUM", F.concat(F.lit("Spl-Rs10 To Rs"), (1 + c % 9).cast("string"), F.lit("/Bonus-1:2")))
               .when(p == "4-NOT SPECIFIED", F.lit("Dividend - Re 0.40 Per Sh")).otherwise(F.lit("")))
    return o.select((c % 100).alias("symbol"), F.date_trunc("week", "o_orderdate").cast("date").alias("ex_date"),
                    subject.alias("subject"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed round trips; minutes since midnight for opening and closing."""
    o = table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        k.alias("trade_id"), F.col("o_orderdate").cast("date").alias("trade_date"), c.alias("symbol"),
        F.col("o_orderpriority").alias("strategy"),
        F.when(F.col("o_orderstatus") == "F", "stop").when(F.col("o_orderstatus") == "O", "target")
        .otherwise("squareoff").alias("reason"),
        F.when(k % 2 == 0, "long").otherwise("short").alias("side"), (1 + k % 50).alias("quantity"),
        (555 + k % 300).alias("open_min"), (560 + k % 300 + c % 60).alias("close_min"),
        (F.col("o_totalprice") / 100).alias("entry_price"),
        ((F.col("o_totalprice") - 250000) / 1000).alias("gross_pnl"),
        (F.col("o_totalprice") * F.lit(2.82e-5)).alias("costs"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    line = F.concat(
        F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("INFO"),
        F.lit(" SYM"), F.char((65 + u % 26).cast("int")), F.lit(" D 2024-01-"),
        F.when(i % 2 == 0, "06..2024-01-07").otherwise("08..2024-01-12"),
        F.when(i % 3 == 0, " getaddrinfo failed 0x").otherwise(" DH-"), (900 + u % 9).cast("string"))
    return e.select("event_id", line.alias("line"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        k.alias("symbol"), F.col("p_brand").alias("sector"), F.col("p_type").alias("category"), price.alias("price"),
        F.when(k % 7 != 0, price * F.pow(F.lit(10.0), F.col("p_size") % 9 - 4)).alias("market_cap_cr"),
        F.when(k % 11 != 0, k % 60).alias("age_days"))
