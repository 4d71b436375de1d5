"""Sharding by sampled splitters, for shards of near equal bytes.

Records are ordered by a key that starts with the crc32 of the text, so equal texts stand together and unequal ones
spread. A size-weighted sample of keys is drawn (a record of s bytes is drawn as often as s bytes of an evenly sampled
stream would be), its quantiles cut the key space into fine ranges, and a range that turns out overfull is subdivided
by a denser sample from it, and a record that fills a range becomes a range of its own. Whole fine ranges are then dealt to the shards in key order, by the middle of each in the
running bytes; slots count on through a shard's ranges. Only sampled keys and one row per fine range reach the driver.

The law is ``bytes``. A shard differs from the mean by at most about one fine range, 1/256 of a shard, or one record if
that is larger. A group of equal texts is cut only at ranges' ends, and may be cut, since the key goes on with hashes
of the doc_id and of the row's number; the numbered rows are written once, so all reads agree on them.

Cases: a null text has no bytes (size 1) and the crc32 of none, 0; null doc_ids sort first among equal keys; repeated
rows have keys of their own and are cut like others; an empty table gives an empty result. Other
columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import documents, keep
from tapeloom.llm.suite import query

SHARDS, LAW = 16, "bytes"
#: Fine ranges of a shard, and sampled keys of a fine range.
FINE, DRAWS = 256, 8


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of every row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    light = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    of_id, of_row = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 15))
    return light.withColumn("key", F.col("text_crc32") * (1 << 31) + of_id * (1 << 15) + of_row)


def sampled_keys(rows: DataFrame, total: int, draws: int) -> np.ndarray:
    """About ``draws`` keys, each record as often as its size calls for: systematic sampling with a hashed start."""
    start = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    times = F.floor(F.col("size") * F.lit(draws / max(1, total)) + start)
    drawn = rows.select("key", times.cast("int").alias("n")).filter("n > 0").toPandas()
    return np.sort(np.repeat(drawn["key"].to_numpy(np.int64), drawn["n"].to_numpy()))


def range_column(splitters: np.ndarray):
    """Number of splitters at or below the key."""
    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, keys.to_numpy(), side="right"))

    return find("key")


def splitters_for(rows: DataFrame, fine: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Splitters into about ``fine`` ranges, and each range's bytes and rows, measured for just these splitters.

    An overfull range is cut on both sides of each key that fills a range alone, at the keys of a denser sample and at
    the middle of its keys, so every round halves its keys at least, and the rounds end.
    """
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    splitters = np.unique(sampled_keys(rows, total, fine * DRAWS)[DRAWS // 2::DRAWS])
    while True:
        measured = (rows.groupBy(range_column(splitters).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                    F.min("key").alias("low"), F.max("key").alias("high")).toPandas().sort_values("range", ignore_index=True))
        over = measured[(measured["bytes"] > 2 * total / fine) & (measured["low"] < measured["high"])]
        if over.empty:
            return splitters, measured
        inside = rows.filter(range_column(splitters).isin([int(r) for r in over["range"]]))
        dense = sampled_keys(inside, int(over["bytes"].sum()), DRAWS * max(2, int(4 * fine * over["bytes"].sum() / total)))
        heavy = inside.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > total / fine).toPandas()["key"].to_numpy(np.int64)
        low, high = over["low"].to_numpy(np.int64), over["high"].to_numpy(np.int64)
        splitters = np.unique(np.concatenate([splitters, dense[DRAWS // 2::DRAWS], heavy, heavy[heavy < np.iinfo(np.int64).max] + 1, low + (high - low) // 2 + 1]))


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots run from 0 without gaps in each shard."""
    rows = keep(keyed(docs))
    splitters, ranges = splitters_for(rows, shards * fine)
    total = max(1, int(ranges["bytes"].sum()))
    middle = ranges["bytes"].cumsum() - ranges["bytes"] / 2
    ranges["shard"] = np.minimum(middle.to_numpy(np.float64) * shards // total, shards - 1).astype(int)
    ranges["first"] = ranges.groupby("shard")["rows"].cumsum() - ranges["rows"]
    shard_of, first_of = np.zeros(len(splitters) + 1, np.int64), np.zeros(len(splitters) + 1, np.int64)
    shard_of[ranges["range"]], first_of[ranges["range"]] = ranges["shard"], ranges["first"]

    @F.pandas_udf("shard int, first long")
    def home(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard_of[found], "first": first_of[found]})

    placed = rows.withColumn("range", range_column(splitters))
    inside = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    numbered = placed.withColumn("_n", F.row_number().over(inside) - 1).withColumn("_h", home("range"))
    return numbered.select("doc_id", "size", "text_crc32", F.col("_h.shard").alias("shard"), (F.col("_h.first") + F.col("_n")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The rows of ``docs`` as one Parquet folder per shard; for tables with one row per doc_id."""
    homes = keep(shard(docs, shards).select("doc_id", "shard", "slot"))
    docs.join(homes, "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
