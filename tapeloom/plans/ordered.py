"""Exact ranks, quantiles and running sums inside groups of any size.

A plain window over (group) sorts the whole group in one task. When a group may hold a third of all rows that does
not scale, so rows are laid out by range instead: ``repartitionByRange(group, order)`` cuts every large group into
several partitions, the layout is settled once, each partition is scanned on its own, and the totals of earlier
partitions of the same group are added. The table of partition totals has one row per (partition, group) it touches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.session import settle

PART = "_part"


def lay_out(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in group-and-order ranges, tagged with the range they fell in.

    The tag must be the same in every later read, so the layout is written before it is used.
    """
    keys = [F.col(g) for g in group] + list(order)
    return settle(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()))


def _offsets(laid: DataFrame, group: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Sum of ``totals`` over the earlier ranges of the group; the group's own total as ``<name>_all``."""
    per_part = laid.groupBy(*group, PART).agg(*[t.alias(n) for n, t in totals.items()])
    every = Window.partitionBy(*group)
    before = every.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        *group, PART,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_before") for n in totals],
        *[F.sum(n).over(every).alias(f"{n}_all") for n in totals])


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank",
                size: str = "size") -> DataFrame:
    """Row number in ``order`` (which must be unique inside the group) and the group's size."""
    laid = lay_out(df, group, order)
    local = Window.partitionBy(*group, PART).orderBy(*order)
    offs = _offsets(laid, group, {"_n": F.count(F.lit(1))})
    joined = laid.withColumn("_rn", F.row_number().over(local)).join(offs, [*group, PART])
    return (joined.withColumn(name, (F.col("_rn") + F.col("__n_before")).cast("long"))
            .withColumn(size, F.col("_n_all").cast("long"))
            .drop(PART, "_rn", "__n_before", "_n_all"))


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                 sums: Mapping[str, Column], totals: bool = False) -> DataFrame:
    """Inclusive running sums in ``order`` (unique inside the group); with ``totals`` the group's sum as <name>_all."""
    tagged = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    laid = lay_out(tagged, group, order)
    local = (Window.partitionBy(*group, PART).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offs = _offsets(laid, group, {n: F.sum(f"_v_{n}") for n in sums})
    scanned = laid.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_s_{n}") for n in sums])
    joined = scanned.join(offs, [*group, PART])
    return joined.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_{n}_before")).alias(n) for n in sums],
                         *[f"{n}_all" for n in sums if totals])


def running_max(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Largest ``value`` of the earlier rows in ``order`` (unique inside the group); null for a group's first row."""
    laid = lay_out(df, group, order)
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    tops = laid.groupBy(*group, PART).agg(F.max(value).alias("_top")).withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    joined = laid.withColumn("_own", F.max(value).over(inside)).join(tops, [*group, PART])
    return joined.select(*df.columns, F.greatest("_own", "_before").alias(name))


def last_known(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Mapping[str, str], strictly: bool = False) -> DataFrame:
    """Latest value that is not null up to each row in ``order`` (unique inside the group), or before it when ``strictly``.

    ``values``: name -> column. A range is scanned on its own; what it lacks it takes from the last value of the earlier
    ranges of its group.
    """
    laid = lay_out(df, group, [F.col(o) for o in order])
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = laid.groupBy(*group, PART).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_end_{n}") for n, c in values.items()])
    carried = ends.select(*group, PART, *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_carried_{n}") for n in values])
    own = laid.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_own_{n}") for n, c in values.items()])
    return own.join(carried, [*group, PART]).select(*df.columns, *[F.coalesce(f"_own_{n}", f"_carried_{n}").alias(n) for n in values])


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group: how often they occur, how many rows lie below them, and the group's rows.

    Ties collapse in the partial aggregate, so a value carried by a third of the rows is one row here.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_ties")))
    run = running_sums(counts, group, [F.col(value)], {"upto": F.col("_ties")}, totals=True)
    return run.select(*group, value, "_ties", (F.col("upto") - F.col("_ties")).alias("_below"), F.col("upto_all").alias("_n"))


def average_ranks(df: DataFrame, group: Sequence[str], value: str, name: str = "rank",
                  size: str | None = None) -> DataFrame:
    """Average rank of ``value`` inside the group (ties share the mean of their places); null stays null."""
    place = (F.col("_below") + (F.col("_ties") + 1) / 2.0).alias(name)
    ranked = value_counts(df, group, value).select(*group, value, place, *([F.col("_n").alias(size)] if size else []))
    return df.join(ranked, [*group, value], "left")


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group from the counted distinct values, one row per group.

    For probability p the position is p·(n−1); the two neighbouring order statistics are read from the
    (below, ties) intervals that cover them, so no task ever holds a whole group.
    """
    hit = value_counts(df, group, value)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)

        def covers(place: Column) -> Column:
            return (F.col("_below") <= place) & (place < F.col("_below") + F.col("_ties"))

        at_lo = F.max(F.when(covers(lo), F.col(value)))
        at_hi = F.max(F.when(covers(hi), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((at_lo + (at_hi - at_lo) * frac).alias(name))
    return hit.groupBy(*group).agg(*aggs)
