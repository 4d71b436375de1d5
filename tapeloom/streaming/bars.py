"""Ticks to bars, duplicates, running session values and silent symbols on Structured Streaming.

Aggregates are keyed windows: Spark combines partially before the shuffle and keeps one small state row per key, so a
symbol with a third of all ticks costs no more state than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRACE = "5 seconds"


def tick_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of ticks; ``ts`` becomes a zoned timestamp, which watermarks require."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, length: str = "5 minutes", grace: str = GRACE, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLCV per key and window. In append mode a bar is emitted once, after its interval and the grace have passed;
    ticks of windows already closed are dropped. ``ticks``: keys, ts, event_id, px, qty."""
    at = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", grace).groupBy(F.window("ts", length).alias("w"), *keys).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("qty").alias("volume"))
    return bars.select(*keys, F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def stream_dedupe(ticks: DataFrame, keys: Sequence[str], horizon: str) -> DataFrame:
    """First arrival per key; keys are remembered for ``horizon`` of event time."""
    return ticks.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(list(keys))


def stream_session_values(ticks: DataFrame, grace: str = GRACE) -> DataFrame:
    """Session VWAP and extremes per symbol and day: running in update mode, final values in append mode."""
    day = ticks.withWatermark("ts", grace).groupBy(F.window("ts", "1 day").alias("w"), "symbol").agg(
        F.sum(F.col("px") * F.col("qty")).alias("_pv"), F.sum("qty").alias("volume"), F.avg("px").alias("_mean"),
        F.max("px").alias("session_high"), F.min("px").alias("session_low"))
    vwap = F.when(F.col("volume") > 0, F.col("_pv") / F.col("volume")).otherwise(F.col("_mean"))
    return day.select("symbol", F.col("w.start").cast("date").alias("trade_date"), vwap.alias("vwap"), "session_high", "session_low", "volume")


def stream_stale_symbols(ticks: DataFrame, gap: str, grace: str = GRACE) -> DataFrame:
    """Symbols that fell silent: one row per closed activity session, with when it counts as stale."""
    s = ticks.withWatermark("ts", grace).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("ticks"), F.max("ts").alias("last_tick"))
    return s.select("symbol", "last_tick", F.col("w.end").alias("stale_from"), "ticks")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Process all data present into a parquet folder; returns the finished query for its progress."""
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def late_rows_dropped(query) -> int:
    """Rows the watermark dropped in the batches the query still reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
