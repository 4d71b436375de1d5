"""Recursions along series of any length.

An exponential mean is an affine map of the value before it, x̄ = a·x̄' + b, and affine maps compose: a stretch of rows is
one pair (a, b) whatever its length. Rows are laid out in ranges of group and order, so a long series is cut into
stretches; the stretches of cut series are summed up first (one small row each), a fold over these rows gives the value
with which every stretch begins, and then each range is scanned on its own, all its series at once: within a batch the
maps are composed by doubling, in as many steps as the logarithm of the longest stretch.

A range cuts at most the series at its two ends, so the starting values are at most two rows a range and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.plans.ordered import PART, lay_out


@dataclass
class Start:
    """Where series stand before their first row here: value, rows since the last value, values so far (0: none)."""

    value: np.ndarray
    gap: np.ndarray
    count: np.ndarray

    @staticmethod
    def nothing(n: int) -> Start:
        return Start(np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64))


def maps(x: np.ndarray, heads: np.ndarray, start: Start, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of every row, values so far and rows since the last value; a row without a value keeps what was.

    A value after k rows weighs alpha against (1 - alpha)^k of the mean before it. Rows at ``heads`` take their start in.
    """
    at = np.arange(len(x))
    seen = ~np.isnan(x)
    series = np.cumsum(np.bincount(heads, minlength=len(x))) - 1
    begun = start.count[series] > 0
    never = np.int64(-1) << 40
    virtual = np.where(begun, heads[series] - 1 - start.gap[series], never)
    latest = np.maximum.accumulate(np.where(seen, at, -1))
    before = np.concatenate([[-1], latest[:-1]])
    before = np.where(before >= heads[series], before, virtual)
    last = np.where(latest >= heads[series], latest, virtual)
    weight = np.where(seen & (before > never), (1.0 - alpha) ** np.minimum(at - before, 1 << 20), 0.0)
    a = np.where(seen, weight / (weight + alpha), 1.0)
    b = np.where(seen, alpha * np.where(seen, x, 0.0) / (weight + alpha), 0.0)
    b[heads] += a[heads] * start.value
    a[heads] = 0.0
    values = np.cumsum(seen)
    count = values - (values - seen)[heads][series] + start.count[series]
    return a, b, count, np.where(last > never, at - last, 0)


def composed(a: np.ndarray, b: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's map after all earlier ones; maps with a = 0 begin anew."""
    step = 1
    while step < longest:
        b = np.concatenate([b[:step], a[step:] * b[:-step] + b[step:]])
        a = np.concatenate([a[:step], a[step:] * a[:-step]])
        step *= 2
    return a, b


def summed_up(x: np.ndarray, alpha: float) -> tuple[int, int, float, float, float, int, int]:
    """A stretch: rows, rows up to its first value (0: none), that value, (a, b) of what follows it, values, rows since the last."""
    seen = np.flatnonzero(~np.isnan(x))
    if not len(seen):
        return len(x), 0, 0.0, 1.0, 0.0, 0, len(x)
    first = int(seen[0])
    a, b, count, gap = maps(x[first:], np.array([0]), Start.nothing(1), alpha)
    a[0], b[0] = 1.0, 0.0
    all_a, all_b = composed(a, b, len(a))
    return len(x), first + 1, float(x[first]), float(all_a[-1]), float(all_b[-1]), int(count[-1]), int(gap[-1])


def exponential_means(df: DataFrame, group: Sequence[str], order: str, specs: Mapping[str, tuple[str, float, int]]) -> DataFrame:
    """Add exponential means x̄ₜ = x̄ₜ₋₁ + α(xₜ − x̄ₜ₋₁); ``specs``: name -> (column, α, values needed).

    Rows without a value keep the mean before them, and the older mean fades over them. ``order`` is unique in a group.
    """
    todo, keys = list(specs.values()), list(group)
    laid = lay_out(df, keys, [F.col(order)])
    slim = laid.select(*keys, PART, order, *dict.fromkeys(c for c, _, _ in todo))
    key_fields = [laid.schema[k] for k in keys]
    states = [T.StructField(f"_{part}{i}", kind) for i in range(len(todo)) for part, kind in (("value", T.DoubleType()), ("gap", T.LongType()), ("count", T.LongType()))]

    cut = slim.groupBy(*keys).agg(F.min(PART).alias("_low"), F.max(PART).alias("_high")).filter("_low < _high").select(*keys)
    names = [f"_{part}{i}" for i in range(len(todo)) for part in ("rows", "lead", "first", "a", "b", "n", "gap")]
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.LongType()] * len(todo)
    part_field = laid.schema[PART]

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        said = [v for col, alpha, _ in todo for v in summed_up(pdf[col].to_numpy(np.float64, na_value=np.nan), alpha)]
        return pd.DataFrame([[*(pdf[k].iat[0] for k in keys), pdf[PART].iat[0], *said]], columns=[*keys, PART, *names])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PART, ignore_index=True)
        out = {k: pdf[k] for k in [*keys, PART]}
        for i, (_, alpha, _) in enumerate(todo):
            value, gap, count, rows = 0.0, 0, 0, []
            for r, lead, first, a, b, n, after in pdf[names[7 * i:7 * i + 7]].itertuples(index=False):
                rows.append((value, gap, count))
                if n:
                    weight = (1.0 - alpha) ** (gap + lead) if count else 0.0
                    value, gap = a * ((weight * value + alpha * first) / (weight + alpha)) + b, after
                elif count:
                    gap += r
                count += n
            out |= dict(zip((f"_value{i}", f"_gap{i}", f"_count{i}"), zip(*rows, strict=True), strict=True))
        return pd.DataFrame(out)

    stretches = (slim.join(cut, keys, "left_semi").groupBy(*keys, PART)
                 .applyInPandas(stretch, T.StructType([*key_fields, part_field, *map(T.StructField, names, kinds)])))
    begins = stretches.groupBy(*keys).applyInPandas(starts, T.StructType([*key_fields, part_field, *states]))
    held = laid.join(F.broadcast(begins), [*keys, PART], "left").sortWithinPartitions(*keys, order)
    return _scanned(held, df.schema, keys, specs, True)


def exponential_means_of_bars(df: DataFrame, group: Sequence[str], order: str, specs: Mapping[str, tuple[str, float, int]]) -> DataFrame:
    """The same for rows that lie series by series in their partitions, as windows by ``group`` leave them: nothing is laid out.

    A task streams through its series in order and holds one batch, whatever their length; one series is one task's work.
    """
    return _scanned(df.sortWithinPartitions(*group, order), df.schema, list(group), specs, False)


def _scanned(held: DataFrame, fields: T.StructType, keys: list[str], specs: Mapping[str, tuple[str, float, int]], cut: bool) -> DataFrame:
    """One pass over rows that lie series by series, in order; with ``cut`` the first row of a stretch tells how it begins."""
    todo, columns = list(specs.values()), fields.names
    schema = T.StructType([*fields.fields, *(T.StructField(n, T.DoubleType()) for n in specs)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = None, [Start.nothing(1) for _ in todo]
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                column = batch.column(k)
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True))
            heads = np.flatnonzero(new)
            same = before is not None and all(batch.column(k)[0].equals(v) for k, v in zip(keys, before, strict=True))
            longest, means = int(np.diff(heads, append=batch.num_rows).max()), []
            for i, (col, alpha, least) in enumerate(todo):
                start = Start.nothing(len(heads))
                if cut:
                    given = [np.asarray(pc.fill_null(batch.column(f"_{part}{i}"), 0))[heads] for part in ("value", "gap", "count")]
                    start = Start(*(g.copy() for g in given))
                if same:
                    start.value[0], start.gap[0], start.count[0] = carried[i].value[0], carried[i].gap[0], carried[i].count[0]
                x = np.asarray(pc.fill_null(batch.column(col).cast(pa.float64()), np.nan), np.float64)
                a, b, count, gap = maps(x, heads, start, alpha)
                mean = composed(a, b, longest)[1]
                carried[i] = Start(mean[-1:].copy(), gap[-1:].copy(), count[-1:].copy())
                means.append(pa.array(mean, mask=count < max(least, 1)))
            before = [batch.column(k)[batch.num_rows - 1] for k in keys]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *means], names=schema.names)

    return held.mapInArrow(scan, schema)
