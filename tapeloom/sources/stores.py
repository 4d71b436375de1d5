"""Stored records: JSON stores, CSV records, partitioned panels, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.functions.frames import cleaned


def scan_bars(bars: DataFrame, start: str | None = None, end: str | None = None, min_bars: int = 1,
              ts: str = "date") -> DataFrame:
    """Bars in [start, end + 1 day]; series with fewer than ``min_bars`` of them are dropped."""
    rows = bars
    if start is not None:
        rows = rows.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col(ts) <= F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return counted.filter(F.col("_n") >= min_bars).drop("_n")


def scan_many_missing(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Every requested symbol with whether any bar exists for it."""
    have = bars.select("symbol").distinct().withColumn("found", F.lit(True))
    return requested.join(have, "symbol", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def bar_coverage(requested: DataFrame, bars: DataFrame, ts: str = "date") -> DataFrame:
    stats = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return requested.join(stats, "symbol", "left").select(
        "symbol", F.col("bars").isNotNull().alias("cached"), F.coalesce("bars", F.lit(0)).alias("bars"), "first", "last")


def explode_json_map(df: DataFrame, text: str, value_type: str = "bigint") -> DataFrame:
    """JSON dictionary column to one row per entry; text that does not parse yields no rows."""
    entries = F.explode(F.from_json(F.col(text), f"map<string,{value_type}>")).alias("key", "value")
    return df.select(*[c for c in df.columns if c != text], entries)


def scan_json_store(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Store files of the form ``{"companies": {symbol: record}}``; unreadable files give no rows."""
    schema = T.StructType([T.StructField("companies", T.MapType(T.StringType(), record))])
    store = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return cleaned(store.select(F.explode("companies").alias("symbol", "record")).select("symbol", "record.*"))


def scan_csv_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return cleaned(spark.read.schema(schema).option("header", True).csv(path))


def write_panel(panel: DataFrame, path: str) -> None:
    """One long table, a folder per year, each year's rows sorted by series and date."""
    (panel.withColumn("year", F.year("date")).repartition("year", "symbol").sortWithinPartitions("symbol", "date")
     .write.mode("overwrite").partitionBy("year").parquet(path))


def write_bucketed_panel(panel: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The panel as a table bucketed and sorted by series: windows, joins and groupings by symbol read it without a shuffle
    (joins by symbol and date too, with ``spark.sql.requireAllClusterKeysForCoPartition`` off).

    One shuffle at write time puts every bucket into one file; ``buckets`` sizes the tasks of all later reads (a series
    has at most one row per session, so no series can outgrow its bucket).
    """
    spark = panel.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (panel.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "date")
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """Each report as CSV for people and JSON for programs."""
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
        df.write.mode("overwrite").json(f"{folder}/{name}.json")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key does not arrive, plus all arriving rows."""
    return stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def upsert_by_date(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["trade_date"])


def upsert_by_key(stored: DataFrame, incoming: DataFrame, key: str = "symbol") -> DataFrame:
    """Whole-record replacement; arriving rows with a blank key are ignored."""
    named = incoming.filter(F.trim(F.col(key).cast("string")) != "")
    return upsert(stored, named, [key])
