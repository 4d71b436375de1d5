"""Exits and excursions through an index of extremes per block of bars.

A session's bars are cut into blocks of ``block`` bars in time order, each with its highest high and lowest low. The
blocks of a session are one small array (bounded by the session's length), so a trade meets one index row, finds by the
extremes the first block that can end it, and reads the bars of that block and of the one it was filled in: three joined
rows a trade instead of one a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.intraday import LONG, SessionTimes, clock

SESSION = ["symbol", "trade_date"]
KEYS = [*SESSION, "bar_ts"]


def blocks_of_bars(bars: DataFrame, times: SessionTimes, block: int = 4) -> DataFrame:
    """symbol, trade_date, block, first, last, hi, lo, ends (holds a bar that closes the session) and its bars in order."""
    w = Window.partitionBy(*SESSION)
    numbered = bars.select(*SESSION, F.floor((F.row_number().over(w.orderBy("bar_ts")) - 1) / block).cast("int").alias("block"),
                           F.struct(F.col("bar_ts").alias("t"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                                    ((clock() >= times.square_off) | (F.col("bar_ts") == F.max("bar_ts").over(w))).alias("end")).alias("b"))
    return numbered.groupBy(*SESSION, "block").agg(
        F.min("b.t").alias("first"), F.max("b.t").alias("last"), F.max("b.h").alias("hi"), F.min("b.l").alias("lo"),
        F.max("b.end").alias("ends"), F.array_sort(F.collect_list("b")).alias("bars"))


def block_index(blocks: DataFrame) -> DataFrame:
    """One row per session: its blocks without their bars, in order."""
    return blocks.groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("block", "first", "last", "hi", "lo", "ends"))).alias("blocks"))


def _stops(hi: Column, lo: Column) -> Column:
    return F.when(F.col("side") == LONG, lo <= F.col("stop")).otherwise(hi >= F.col("stop"))


def _wins(hi: Column, lo: Column) -> Column:
    return F.when(F.col("side") == LONG, hi >= F.col("target")).otherwise(lo <= F.col("target"))


def first_touch_by_blocks(filled: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``outcomes.first_touch_exit``: first later bar that touches stop or target, the stop first, else the square-off close.

    Every bar of a block after the fill's own can end the trade, so the first such block whose extremes reach a level,
    or that closes the session, surely holds the exit if the fill's own block does not.
    """
    fill = F.col("fill_ts")
    met = filled.select(*KEYS, "side", "stop", "target", "fill_ts").join(block_index(blocks), SESSION)
    own = F.filter("blocks", lambda x: (x["first"] <= fill) & (x["last"] >= fill))
    later = F.filter("blocks", lambda x: (x["first"] > fill) & (x["ends"] | _stops(x["hi"], x["lo"]) | _wins(x["hi"], x["lo"])))
    wanted = F.concat(F.transform(own, lambda x: x["block"]), F.transform(F.slice(later, 1, 1), lambda x: x["block"]))
    near = met.withColumn("block", F.explode(wanted)).drop("blocks").join(blocks.select(*SESSION, "block", "bars"), [*SESSION, "block"])

    def outcome(b: Column) -> Column:
        after = b["t"] > fill
        return (F.when(after & _stops(b["h"], b["l"]), F.struct(b["t"].alias("t"), F.lit("stop").alias("reason"), F.col("stop").alias("price")))
                .when(after & _wins(b["h"], b["l"]), F.struct(b["t"].alias("t"), F.lit("target").alias("reason"), F.col("target").alias("price")))
                .when((b["t"] >= fill) & b["end"], F.struct(b["t"].alias("t"), F.lit("squareoff").alias("reason"), b["c"].alias("price"))))

    hits = F.filter(F.transform("bars", outcome), lambda x: x.isNotNull())
    first = near.withColumn("_x", F.get(hits, 0)).groupBy(*KEYS).agg(F.min("_x").alias("_x"))
    return filled.join(first.filter(F.col("_x").isNotNull()), KEYS).select(
        filled["*"], F.col("_x.t").alias("exit_ts"), F.col("_x.reason").alias("reason"), F.col("_x.price").alias("exit_ref"))


def excursion_by_blocks(closed: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``outcomes.excursion``: best favourable price after the fill until the exit bar.

    Blocks wholly inside the holding time count by their extremes; bars are read of the blocks at its two ends only.
    """
    fill, leave = F.col("fill_ts"), F.col("exit_ts")
    met = closed.select(*KEYS, "side", "fill_ts", "exit_ts", "fill_price").join(block_index(blocks), SESSION)
    held = F.filter("blocks", lambda x: (x["last"] > fill) & (x["first"] <= leave))
    inner = F.filter(held, lambda x: (x["first"] > fill) & (x["last"] <= leave))
    rim = F.filter(held, lambda x: ~((x["first"] > fill) & (x["last"] <= leave)))
    met = met.select(*KEYS, "side", "fill_ts", "exit_ts", "fill_price", F.array_max(F.transform(inner, lambda x: x["hi"])).alias("_hi"),
                     F.array_min(F.transform(inner, lambda x: x["lo"])).alias("_lo"), F.explode_outer(F.transform(rim, lambda x: x["block"])).alias("block"))
    near = met.join(blocks.select(*SESSION, "block", "bars"), [*SESSION, "block"], "left")
    inside = F.filter("bars", lambda b: (b["t"] > fill) & (b["t"] <= leave))
    near = near.withColumns({"_hi": F.greatest("_hi", F.array_max(F.transform(inside, lambda b: b["h"]))), "_lo": F.least("_lo", F.array_min(F.transform(inside, lambda b: b["l"])))})
    g = near.groupBy(*KEYS, "side", "fill_price").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    return g.select(*KEYS, F.when(F.col("side") == LONG, F.greatest("fill_price", "_hi")).otherwise(F.least("fill_price", "_lo")).alias("best_price"))
