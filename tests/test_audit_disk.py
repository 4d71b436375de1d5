"""The causality audit keeps on disk what it still reads: no shuffles of ended queries, no copy of the ticks, nothing at the end."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tapeloom.functions import indicators as ind
from tapeloom.functions import moving as mv
from tapeloom.session import ensure_checkpoint_dir, settle, settled_apart
from tapeloom.sources import tables as src
from tapeloom.suite import audits as suite_audits

SMALL = "/root/testdata/sf0.001"


def files(tops, wanted):
    return {f"{d}/{x}" for top in tops for d, _, names in os.walk(top) for x in names if wanted(x)}


def shuffles(spark):
    return files([str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()], lambda x: x.startswith("shuffle_"))


def audit(spark):
    return dict(map(tuple, queries()["truncation_invariance"](spark, SMALL).collect()))


@pytest.mark.parametrize("ticks", [1000, 1 << 23])
def test_nothing_stays_on_disk(spark, monkeypatch, ticks):
    """Before, every shuffle of every query stayed until the driver collected its garbage, and the cut ticks were written."""
    monkeypatch.setattr(suite_audits, "CAUSAL", ("sma", "atr_wilder", "eligibility", "rank_top_n", "winsorised_z"))
    monkeypatch.setattr(suite_audits, "SLICE_TICKS", ticks)
    shared = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/").rpartition("/")[0]
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, kept, held = spark.conf.get(key), files([shared], lambda x: True), shuffles(spark)
    found = queries()["truncation_invariance"](spark, SMALL)
    assert not shuffles(spark) - held and not files([shared], lambda x: True) - kept
    assert set(map(tuple, found.collect())) == {(name, 0) for name in suite_audits.CAUSAL}
    assert spark.conf.get(key) == was and not [t.name for t in spark.catalog.listTables() if t.name.startswith("panel_")]


def test_parts_of_the_series_find_what_the_whole_finds(spark, monkeypatch):
    def peeks(spark, sf):
        """Not causal by series, nor by date."""
        top = F.max("close").over(ind.own().rowsBetween(0, 1))
        return src.panel(spark, sf).select("symbol", "date", "session_no", top.alias("top"))

    monkeypatch.setattr(suite_audits, "CAUSAL", ("sma", "rank_top_n"))
    for name in suite_audits.CAUSAL:
        monkeypatch.setitem(suite_audits.QUERIES, name, peeks)
    seen = []
    for ticks in (1 << 23, 700):
        monkeypatch.setattr(suite_audits, "SLICE_TICKS", ticks)
        seen.append(audit(spark))
    assert seen[0] == seen[1] and seen[0]["sma"] == seen[0]["rank_top_n"] > 0


def test_sliced_panel_has_the_rows_of_the_panel(spark):
    want = sorted(map(tuple, src.panel(spark, SMALL).collect()), key=str)
    with src.sliced_panel(spark, SMALL, 3, 4):
        assert sorted(map(tuple, src.panel(spark, SMALL).collect()), key=str) == want
        parts = []
        for part in range(3):
            with src.one_slice(part):
                parts.append([tuple(r) for r in src.panel(spark, SMALL).collect()])
        plan = src.panel(spark, SMALL).withColumn("m", ind.sma("close", 5))._jdf.queryExecution().executedPlan().toString()
    assert sorted((r for p in parts for r in p), key=str) == want and all(parts)
    assert "Exchange" not in plan


def test_settled_apart_goes_and_the_folder_comes_back(spark):
    base = ensure_checkpoint_dir(spark).rstrip("/").rpartition("/")[0]
    for _ in range(2):
        with settled_apart(spark):
            assert settle(spark.range(10)).count() == 10
            inside = spark.sparkContext.getCheckpointDir()
        now = spark.sparkContext.getCheckpointDir()
        assert now.rstrip("/").rpartition("/")[0] == base and not os.path.exists(inside.removeprefix("file:"))


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_streamed_statistics_equal_those_of_pieces(spark, monkeypatch, batch):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(n), None if n % 7 == 0 else float(round(rng.normal(50, 4), 1))) for n, s in enumerate(np.where(rng.random(2000) < 1 / 3, 7, rng.integers(0, 40, 2000)))]
    df = spark.createDataFrame(rows, "symbol long, session_no long, close double")
    monkeypatch.setattr(mv, "WIDE", 50)
    specs = {k: mv.Moving(k, "close", w, n, o) for k, w, n, o in (("median", 20, 1, False), ("rank", 60, 10, True), ("below", 25, 6, False), ("mean", 40, 2, True), ("max", 30, 1, True), ("slope", 4, 1, False))}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, want = (d.toPandas().sort_values(["symbol", "session_no"], ignore_index=True) for d in (mv.moving_of_bars(df.repartition(3), specs), mv.moving(df, specs)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got.equals(want) and got[list(specs)].notna().sum().min() > 500
    assert "_piece" not in ind.compute_factors(src.panel(spark, SMALL))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["compute_factors", "clenow_investable", "liquidity_factors", "eligibility", "efficiency_percentile", "atr_wilder", "ema"])
def test_queries_by_series_read_the_stored_panel_without_a_shuffle(spark, name):
    with src.sliced_panel(spark, SMALL, 1, 4):
        assert "Exchange" not in queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
