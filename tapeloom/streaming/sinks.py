"""foreachBatch sinks: batch operators on the stream's output, idempotent per batch id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators import intraday as idy
from tapeloom.operators import outcomes as oc
from tapeloom.session import settle
from tapeloom.sources.keyed import KeyedStore


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


@dataclass
class SignalSink:
    """Confirmed bars in, routed signals and next-bar fills out.

    Bars are kept as a table by batch and day; each batch reads back only the days it touches (a filter on folders), runs
    the batch operators on the sessions it touches, and writes the decisions made on its own bars and the fills its own bars price.
    """

    folder: str
    enrich: Callable[[DataFrame], DataFrame]
    registry: idy.RuleRegistry
    times: idy.SessionTimes
    slippage_bps: float = 5.0

    def history(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All bars written so far, with their batch."""
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.folder}/bars")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bars = batch.withColumn("trade_date", F.col("bar_ts").cast("date")).filter(idy.clock().between(self.times.market_open, self.times.market_close))
        bars.write.mode("overwrite").partitionBy("trade_date").parquet(f"{self.folder}/bars/batch={batch_id}")
        table = self.history(spark, bars.schema).filter(F.col("batch") <= batch_id)
        mine = table.filter(F.col("batch") == batch_id)
        days = [r[0] for r in mine.select("trade_date").distinct().collect()]
        table = table.filter(F.col("trade_date").isin(days))
        rows = table.join(mine.select("symbol", "trade_date").distinct(), ["symbol", "trade_date"], "left_semi").drop("batch")
        rows = settle(rows)
        routed = settle(idy.route_signals(self.registry.run(self.enrich(idy.with_features(rows, self.times))), self.times))
        keys = mine.select("symbol", "bar_ts")
        routed.join(keys, ["symbol", "bar_ts"], "left_semi").write.mode("overwrite").parquet(f"{self.folder}/signals/batch={batch_id}")
        fills = oc.next_bar_fill(routed, rows, self.slippage_bps)
        priced = fills.join(keys.withColumnRenamed("bar_ts", "fill_ts"), ["symbol", "fill_ts"], "left_semi")
        priced.write.mode("overwrite").parquet(f"{self.folder}/fills/batch={batch_id}")


@dataclass
class RecordSink:
    """Session records replaced by key; a batch rewrites only the parts of the table that its keys fall into.

    A repeated batch finds its version published and changes nothing.
    """

    folder: str
    key: str = "trade_date"
    parts: int = 16

    @property
    def store(self) -> KeyedStore:
        return KeyedStore(self.folder, (self.key,), self.parts)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.store.read(spark)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        order = F.struct("written_at") if "written_at" in batch.columns else F.struct(*[c for c in batch.columns if c != self.key])
        rest = [c for c in batch.columns if c != self.key]
        newest = batch.groupBy(self.key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(self.key, "_r.*")
        self.store.upsert(newest, batch_id)
