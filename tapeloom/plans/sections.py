"""Whole cross-sections of many dates at once: a group that fits one task is worked on as arrays, a wider one elsewhere.

One shuffle by group replaces the long form of one row per value, which costs a count, a range layout and two joins for
every statistic. A task holds one group of at most ``MOST`` rows; the rows of wider groups go to an exact way that the
caller gives, such as the range-ordered helpers of ``plans/ordered.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import settle

#: Rows of the widest group that one task takes whole.
MOST = 1 << 20


def sections(df: DataFrame, group: Sequence[str], work: Callable[[pa.Table], pa.Table], schema: T.StructType,
             wider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on every group of at most ``MOST`` rows, ``wider`` on the rows of all other groups.

    ``df`` is read twice, so it is to be settled. The wide groups are fewer than one in ``MOST`` rows and are broadcast.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MOST)
    wide = settle(sizes.select(*[F.col(g).alias(f"_w_{g}") for g in group]))
    if wide.isEmpty():
        return df.groupBy(*group).applyInArrow(work, schema)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_w_{g}")) for g in group])
    whole = df.join(F.broadcast(wide), same, "left_anti").groupBy(*group).applyInArrow(work, schema)
    return whole.unionByName(wider(df.join(F.broadcast(wide), same, "left_semi")).select(*schema.names))


def values(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column as doubles, and which rows have a value."""
    column = table.column(name).cast(pa.float64())
    return np.asarray(pc.fill_null(column, 0.0), np.float64), np.asarray(column.is_valid())


def doubles(x: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=~known)


def median(x: np.ndarray) -> float:
    """Interpolated median; the order puts NaN last."""
    low, high = (len(x) - 1) // 2, len(x) // 2
    at = np.partition(x, (low, high))
    return at[low] + (at[high] - at[low]) * 0.5 if high > low else at[low]


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Places from 1 in ascending order; ties share the mean of theirs, NaN is the largest value."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(len(s), 1), bool), (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]))
    ties = np.diff(np.append(start, len(s)))
    out = np.empty(len(s))
    out[order] = np.repeat(start + (ties + 1) / 2, ties)
    return out
