"""Company identity across renames and key changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.plans import ordered
from tapeloom.plans.components import connected_components

MAX_LINK_GAP_DAYS = 730
SUSPICIOUS_GAP_DAYS = 180


def identity_observations(rows: DataFrame) -> DataFrame:
    """(symbol, isin) pairs with the first and last day they were seen together."""
    return rows.groupBy("symbol", "isin").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def symbol_eras(obs: DataFrame, max_gap_days: int = MAX_LINK_GAP_DAYS) -> DataFrame:
    """Number the uses of a symbol; a new era starts after a gap from the latest end seen so far.

    Runs on the pair table, where a symbol has one row per key it ever carried. A hub symbol may carry a third of all
    keys, so its rows are scanned in ranges.
    """
    order = [F.col("first"), F.col("isin")]
    reached = ordered.running_max(obs, ["symbol"], order, "last", "_reach")
    fresh = F.coalesce((F.datediff("first", "_reach") > max_gap_days).cast("int"), F.lit(0))
    return ordered.running_sums(reached, ["symbol"], order, {"era": fresh.cast("long")}).drop("_reach")


@dataclass(frozen=True)
class Entities:
    """Dimension tables of a resolved archive."""

    by_isin: DataFrame
    observations: DataFrame

    def display(self) -> DataFrame:
        """Most recently seen symbol of each entity."""
        return self._labelled().groupBy("entity").agg(
            F.max_by("symbol", F.struct("last", "symbol")).alias("display"))

    def by_symbol(self) -> DataFrame:
        """Entity of each symbol's most recent use."""
        return self._labelled().groupBy("symbol").agg(
            F.max_by("entity", F.struct("last", "entity")).alias("entity"))

    def stats(self) -> DataFrame:
        per = self.by_isin.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.sum("n").alias("isins"), F.count(F.lit(1)).alias("entities"),
                       F.count_if(F.col("n") > 1).alias("merged"))

    def _labelled(self) -> DataFrame:
        return self.observations.join(self.by_isin, "isin")


def resolve_from_observations(obs: DataFrame, max_gap_days: int = MAX_LINK_GAP_DAYS) -> Entities:
    """Components over (isin, symbol#era); the entity is named by its smallest isin."""
    eras = symbol_eras(obs, max_gap_days)
    edges = eras.select("isin", F.concat_ws("#", "symbol", "era").alias("node"))
    labels = connected_components(edges, "isin", "node").withColumnRenamed("label", "entity")
    return Entities(labels, obs)


def resolve_entities(rows: DataFrame, max_gap_days: int = MAX_LINK_GAP_DAYS) -> Entities:
    return resolve_from_observations(identity_observations(rows), max_gap_days)


def entity_map_join(rows: DataFrame, entities: Entities) -> DataFrame:
    return rows.join(entities.by_isin, "isin")


def entity_fallback_lookup(records: DataFrame, entities: Entities) -> DataFrame:
    """Entity by isin, else by symbol; null when neither is known."""
    direct = entities.by_isin.withColumnRenamed("entity", "_by_isin")
    other = entities.by_symbol().withColumnRenamed("entity", "_by_symbol")
    return (records.join(direct, "isin", "left").join(other, "symbol", "left")
            .withColumn("entity", F.coalesce("_by_isin", "_by_symbol")).drop("_by_isin", "_by_symbol"))


def suspicious_gaps(rows: DataFrame, gap_days: int = SUSPICIOUS_GAP_DAYS) -> DataFrame:
    """Entities whose listed sessions contain a long gap; ``rows`` carry entity and date."""
    days = rows.select("entity", "date").distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("entity").orderBy("date")))
    per = days.withColumn("_gap", gap).groupBy("entity").agg(
        F.max("_gap").cast("long").alias("max_gap_days"), F.count(F.lit(1)).alias("sessions"))
    return per.filter((F.col("sessions") >= 2) & (F.col("max_gap_days") >= gap_days))


def entity_day_collapse(rows: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """One row per entity-day; each field is its last non-null value in ``order``."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields]
    return rows.groupBy("entity", "date").agg(*last)


def exact_key_guard(asked: DataFrame, provided: DataFrame) -> DataFrame:
    """Provider rows with whether the code they answer with is the symbol that was asked for."""
    pair = asked.join(provided, "request_id")
    return pair.withColumn("accepted", F.coalesce(F.upper("code") == F.upper("symbol"), F.lit(False)))
