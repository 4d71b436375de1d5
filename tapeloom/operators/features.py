"""Feature set, purged walk-forward folds, model fits and per-date scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.functions.frames import beside, lookback, ratio, rolling
from tapeloom.plans import ordered, sections
from tapeloom.session import settle


@dataclass(frozen=True)
class FeatureParams:
    momentum: tuple[int, ...] = (21, 63, 126)
    year: int = 252
    skip: int = 21
    vol: int = 63
    reversal: int = 5
    turnover: int = 21
    horizon: int = 21

    @property
    def names(self) -> list[str]:
        return [*[f"mom_{w}" for w in self.momentum], f"mom_{self.year}", "vol", "rev", "turnover_log"]


def raw_features(panel: DataFrame, p: FeatureParams = FeatureParams(), leak: bool = False) -> DataFrame:
    """Features from sessions up to t and the forward return label; incomplete rows are dropped.

    Returns are session-exact (a gap is never padded). ``leak`` turns the label backwards so that a test can show
    that a leak would be visible.
    """
    close = F.col("close")
    base = panel.withColumn("_ret", ratio(close, lookback("close", 1)) - 1)
    cols = {f"mom_{w}": ratio(close, lookback("close", w)) - 1 for w in p.momentum}
    cols[f"mom_{p.year}"] = ratio(lookback("close", p.skip), lookback("close", p.year)) - 1
    cols["vol"] = rolling(F.stddev_samp("_ret"), "_ret", p.vol)
    cols["rev"] = ratio(close, lookback("close", p.reversal)) - 1
    traded = F.col("volume") * close
    cols["turnover_log"] = F.log1p(rolling(F.avg(traded), traded, p.turnover))
    ahead = lookback("close", p.horizon) if leak else lookback("close", -p.horizon)
    rows = base.withColumns({**cols, "y": ratio(ahead, close) - 1})
    return rows.select("date", "session_no", "symbol", *p.names, "y").na.drop()


def rank_normalise(rows: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Average rank ÷ n − 0.5 of every column inside its date.

    A date is ranked as arrays in one task, all columns at once; dates too wide for that are laid out by ranges.
    """
    rows, names = settle(rows), list(names)
    ids = ["date", "symbol"]
    schema = T.StructType([*(rows.schema[c] for c in ids), *(T.StructField(n, T.DoubleType()) for n in names), *(rows.schema[c] for c in keep)])

    def work(table: pa.Table) -> pa.Table:
        made = []
        for n in names:
            (x, known), share = sections.values(table, n), np.zeros(table.num_rows)
            share[known] = sections.average_ranks(x[known]) / max(known.sum(), 1) - 0.5
            made.append(sections.doubles(share, known))
        return pa.Table.from_arrays([*(table.column(c) for c in ids), *made, *(table.column(c) for c in keep)], names=schema.names)

    return sections.sections(rows.select(*ids, *names, *keep), ["date"], work, schema, lambda wide: _ranks_by_ranges(wide, names, keep))


def _ranks_by_ranges(rows: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The same in one long form, for dates of any width: the number of features does not multiply the shuffles."""
    e = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])
    long = rows.select("date", "symbol", F.explode(e).alias("e")).select("date", "symbol", "e.name", "e.x")
    ranked = ordered.average_ranks(long, ["date", "name"], "x", "_r", "_n").withColumn("_v", F.col("_r") / F.col("_n") - 0.5)
    wide = ranked.groupBy("date", "symbol").agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in names])
    return wide.join(rows.select("date", "symbol", *keep), ["date", "symbol"])


def build_features(panel: DataFrame, p: FeatureParams = FeatureParams(), leak: bool = False) -> DataFrame:
    return rank_normalise(raw_features(panel, p, leak), p.names, ["session_no", "y"])


class InsufficientHistory(RuntimeError):
    """No fold meets the minimum sizes."""


@dataclass(frozen=True)
class FoldParams:
    folds: int = 5
    holdout: float = 0.2
    horizon: int = 21
    first_train: float = 0.4
    min_train_dates: int = 100
    min_test_dates: int = 5
    min_train_rows: int = 500
    min_test_rows: int = 100


def fold_ranges(n_dates: int, p: FoldParams = FoldParams()) -> list[dict]:
    """Date-index ranges per fold; fold 0 is the holdout. Training ends ``horizon`` dates before its test."""
    hold = max(1, int(n_dates * p.holdout))
    dev = n_dates - hold
    start = dev * p.first_train
    bounds = [int(start + (dev - start) * i / p.folds) for i in range(p.folds + 1)]
    out = [{"fold": i + 1, "train_to": max(0, bounds[i] - p.horizon), "test_from": bounds[i], "test_to": bounds[i + 1]} for i in range(p.folds)]
    kept = [f for f in out if f["test_to"] - f["test_from"] >= p.min_test_dates and f["train_to"] >= p.min_train_dates]
    return kept + [{"fold": 0, "train_to": max(0, dev - p.horizon), "test_from": dev, "test_to": n_dates}]


def walk_forward_folds(features: DataFrame, p: FoldParams = FoldParams()) -> DataFrame:
    """One row per qualifying fold with its dates and sizes; raises when no fold qualifies.

    Works on per-date row counts: one small row per date, whatever the width of the cross-section.
    """
    per = settle(features.groupBy("date").agg(F.count(F.lit(1)).alias("rows")))
    idx = per.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = per.count()
    spec = fold_ranges(n, p)
    cells = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in f.items()]) for f in spec])
    r = idx.withColumn("f", F.explode(cells)).select("date", "i", "rows", "f.*")
    train, test = F.col("i") < F.col("train_to"), F.col("i").between(F.col("test_from"), F.col("test_to") - 1)
    folds = r.groupBy("fold").agg(
        F.max(F.when(train, F.col("date"))).alias("train_end"), F.min(F.when(test, F.col("date"))).alias("test_start"), F.max(F.when(test, F.col("date"))).alias("test_end"),
        F.sum(F.when(train, F.col("rows")).otherwise(0)).alias("n_train"), F.sum(F.when(test, F.col("rows")).otherwise(0)).alias("n_test"))
    ok = folds.filter((F.col("n_train") >= p.min_train_rows) & (F.col("n_test") >= p.min_test_rows))
    if ok.filter("fold > 0").isEmpty():
        raise InsufficientHistory(f"{n} dates give no fold with {p.min_train_rows} training and {p.min_test_rows} test rows")
    return ok


def fit_predict(features: DataFrame, folds: DataFrame, names: Sequence[str], model: str = "linear", seed: int = 0) -> DataFrame:
    """Out-of-sample predictions per fold: scaler and regressor are fitted on training dates only.

    A fold is one Spark ML job over its rows; the loop runs over the handful of folds.
    """
    out = None
    for f in folds.orderBy("fold").collect():
        train = features.filter(F.col("date") <= F.lit(f["train_end"]))
        test = features.filter(F.col("date").between(F.lit(f["test_start"]), F.lit(f["test_end"])))
        reg = (LinearRegression(featuresCol="scaled", labelCol="y") if model == "linear"
               else GBTRegressor(featuresCol="scaled", labelCol="y", maxIter=20, maxDepth=3, seed=seed + f["fold"]))
        pipe = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="raw"),
                                StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), reg])
        pred = pipe.fit(train).transform(test).select(F.lit(f["fold"]).alias("fold"), "date", "symbol", "y", F.col("prediction").alias("pred"))
        out = pred if out is None else out.unionByName(pred)
    return out


def assign_folds(features: DataFrame, folds: DataFrame, pred: Column) -> DataFrame:
    """Test rows of each fold with a given prediction column instead of a fitted model.

    The folds become a date → fold table, which the calendar bounds.
    """
    days = folds.select("fold", F.explode(F.sequence("test_start", "test_end")).alias("date"))
    return features.join(F.broadcast(days), "date").select("fold", "date", "symbol", "y", pred.alias("pred"))


def rank_ic_deciles(predictions: DataFrame, min_names: int = 20) -> DataFrame:
    """Per fold and date: rank correlation of prediction and outcome, mean outcome of the top and bottom tenth.

    A date is ranked as arrays in one task; dates too wide for that are laid out by ranges.
    """
    rows = settle(predictions, "fold", "date", "symbol", "pred", "y").select("fold", "date", "symbol", F.col("pred").cast("double").alias("pred"), F.col("y").cast("double").alias("y"))
    by = ["fold", "date"]
    schema = T.StructType([*(rows.schema[c] for c in by), *(T.StructField(c, T.DoubleType()) for c in ("ic", "bottom", "top"))])

    def work(table: pa.Table) -> pa.Table:
        figures = _date_figures(table) if table.num_rows >= min_names else None
        one = table.select(by).slice(0, 1 if figures else 0)
        return pa.Table.from_arrays([*one.columns, *(pa.array([v] if figures else [], pa.float64()) for v in figures or (None,) * 3)], names=schema.names)

    return sections.sections(rows, by, work, schema, lambda wide: _deciles_by_ranges(wide, by, min_names))


def _date_figures(table: pa.Table) -> tuple[float | None, float | None, float | None]:
    """Rank correlation, mean outcome of the lowest and of the highest tenth of one date, ties of the prediction by symbol."""
    (pred, told), (y, seen) = sections.values(table, "pred"), sections.values(table, "y")
    a, b = np.full(len(y), np.nan), np.full(len(y), np.nan)
    a[told], b[seen] = sections.average_ranks(pred[told]), sections.average_ranks(y[seen])
    both = told & seen
    a, b = a[both] - a[both].mean(), b[both] - b[both].mean()
    size = np.sqrt((a @ a) * (b @ b))
    symbol = np.asarray(pc.rank(table.column("symbol").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="first"))
    order, k = np.lexsort((symbol, pred, told)), max(1, len(y) // 10)

    def mean(places: np.ndarray) -> float | None:
        kept = y[places][seen[places]]
        return float(kept.mean()) if len(kept) else None

    return float((a @ b) / size) if size > 0 else None, mean(order[:k]), mean(order[-k:])


def _deciles_by_ranges(rows: DataFrame, by: Sequence[str], min_names: int) -> DataFrame:
    """The same for dates of any width."""
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_names)
    rows = rows.join(F.broadcast(wide), by)
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    ra = ordered.average_ranks(rows.select(*by, "symbol", "pred", "y"), by, "pred", "_rp")
    rb = ordered.average_ranks(ra, by, "y", "_ry")
    ic = rb.groupBy(*by).agg(F.corr("_rp", "_ry").alias("ic"))
    placed = ordered.row_numbers(rows, by, [F.col("pred").asc(), F.col("symbol").asc()])
    tails = placed.groupBy(*by).agg(F.avg(F.when(F.col("rank") <= k, F.col("y"))).alias("bottom"), F.avg(F.when(F.col("rank") > F.col("size") - k, F.col("y"))).alias("top"))
    return ic.join(tails, by)


def fold_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("fold").agg(F.avg("ic").alias("ic"), F.avg("top").alias("top"), F.avg("bottom").alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def fold_report(scores: DataFrame) -> DataFrame:
    """Mean IC of the folds, its t over folds, mean spread and the holdout's own figures."""
    dev, hold = F.col("fold") > 0, F.col("fold") == 0
    ic = F.when(dev, F.col("ic"))
    n = F.count(ic)
    return scores.agg(n.alias("folds"), F.avg(ic).alias("mean_ic"), F.when(n >= 2, ratio(F.avg(ic), F.stddev_samp(ic) / F.sqrt(n))).alias("ic_t"),
                      F.avg(F.when(dev, F.col("spread"))).alias("mean_spread"), F.max(F.when(hold, F.col("ic"))).alias("holdout_ic"), F.max(F.when(hold, F.col("spread"))).alias("holdout_spread"))


def synthetic_panel(spark: SparkSession, symbols: int = 606, sessions: int = 1237, seed: int = 7, edge: float = 0.0, drift: float = 0.0004,
                    market_vol: float = 0.009, daily_vol: float = 0.020) -> DataFrame:
    """Seeded control panel: a market factor times dispersed betas plus noise, an optional static drift per name.

    The drift is spread evenly over the names from −edge to +edge. Every draw is a hash of (seed, name, session), so
    the rows do not depend on how they are partitioned.
    """
    def gauss(tag: int, *keys: Column) -> Column:
        def unit(t: int) -> Column:
            return (F.pmod(F.xxhash64(F.lit(seed), F.lit(t), *keys), F.lit(2 ** 52)) + 0.5) / float(2 ** 52)
        return F.sqrt(-2 * F.log(unit(tag))) * F.cos(2 * F.pi() * unit(tag + 1000))
    i, t = F.col("i"), F.col("session_no")
    rows = spark.range(symbols).withColumnRenamed("id", "i").withColumn("session_no", F.explode(F.sequence(F.lit(1), F.lit(sessions))))
    tilt = edge * (2 * i / max(symbols - 1, 1) - 1)
    ret = (drift + market_vol * gauss(1, t)) * (1 + 0.25 * gauss(2, i)) + daily_vol * gauss(3, i, t) + tilt
    w = Window.partitionBy("i").orderBy("session_no")
    px = rows.withColumn("_r", ret).withColumn("close", 100 * F.exp(F.sum(F.log1p("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    opened = F.coalesce(F.lag("close").over(w) * (1 + 0.4 * daily_vol * gauss(4, i, t)), F.col("close"))
    turn = 5e7 * F.exp(0.3 * gauss(5, i, t))
    date = F.date_add(F.lit("2000-01-03").cast("date"), (F.floor((t - 1) / 5) * 7 + (t - 1) % 5).cast("int"))
    return px.select(F.format_string("SYN%06d", i).alias("symbol"), date.alias("date"), t.cast("int").alias("session_no"), opened.alias("open"), "close",
                     (turn / F.col("close")).alias("volume"), turn.alias("turnover"))


def control_verdict(planted: DataFrame, noise: DataFrame, real: DataFrame, threshold: float = 0.02) -> DataFrame:
    """The real figure may be read only when the planted edge is found and pure noise is not."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("mean_ic").alias(name))
    j = beside(beside(one(planted, "planted_ic"), one(noise, "noise_ic")), one(real, "real_ic"))
    found, quiet = F.coalesce(F.col("planted_ic") > threshold, F.lit(False)), F.coalesce(F.abs("noise_ic") < threshold, F.lit(False))
    return j.withColumns({"found": found, "quiet": quiet, "readable": found & quiet})
