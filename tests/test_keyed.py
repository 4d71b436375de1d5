"""Keyed stores, digest trees and the bucketed layout."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators import digests as dg
from tapeloom.sources import stores
from tapeloom.sources.keyed import Files, KeyedStore

SCHEMA = "k long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(store):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{store.folder}/data") for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_parts_only(spark, frame, tmp_path):
    store = KeyedStore(str(tmp_path), ("k",), 16)
    store.upsert(frame([(i, "old") for i in range(200)], SCHEMA))
    before = files_of(store)
    touched = store.upsert(frame([(7, "new"), (7, "twice"), (500, "more")], SCHEMA))
    assert 1 <= len(touched) <= 2
    fresh = files_of(store) - before
    assert {f.split("_part=")[1].split("/")[0] for f in fresh} == {str(p) for p in touched}
    want = [(i, "old") for i in range(200) if i != 7] + [(7, "new"), (7, "twice"), (500, "more")]
    assert rows(store.read(spark)) == sorted(want, key=str)


def test_null_and_repeated_keys(spark, frame, tmp_path):
    store = KeyedStore(str(tmp_path), ("k",), 4)
    store.upsert(frame([(None, "a"), (None, "b"), (1, None)], SCHEMA))
    store.upsert(frame([(None, "c")], SCHEMA))
    store.upsert(frame([], SCHEMA))
    assert rows(store.read(spark)) == sorted([(None, "c"), (1, None)], key=str)


def test_crash_before_the_manifest_leaves_the_old_version(spark, frame, tmp_path, monkeypatch):
    store = KeyedStore(str(tmp_path), ("k",), 4)
    store.upsert(frame([(1, "a"), (2, "b")], SCHEMA), 0)

    def crash(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(Files, "publish", crash)
        with pytest.raises(OSError):
            store.upsert(frame([(1, "x")], SCHEMA), 1)
    assert rows(store.read(spark)) == [(1, "a"), (2, "b")]
    store.upsert(frame([(1, "y")], SCHEMA), 1)
    store.upsert(frame([(1, "late repeat")], SCHEMA), 1)
    assert rows(store.read(spark)) == [(1, "y"), (2, "b")]


def test_old_versions_go(spark, frame, tmp_path):
    store = KeyedStore(str(tmp_path), ("k",), 2)
    for i in range(6):
        store.upsert(frame([(j, f"v{i}") for j in range(20)], SCHEMA))
    live = {f.split("/v=")[1].split("/")[0] for f in files_of(store)}
    assert live == {"4", "5"}
    kept = [n for n in os.listdir(tmp_path / "manifest") if n.endswith(".json") and not n.startswith(".")]
    assert sorted(kept) == ["v-000000000004.json", "v-000000000005.json"]
    assert json.loads((tmp_path / "manifest" / kept[0]).read_text())["live"]


def test_a_reader_of_the_version_before_still_reads(spark, frame, tmp_path):
    store = KeyedStore(str(tmp_path), ("k",), 2)
    store.upsert(frame([(1, "a")], SCHEMA))
    reader = store.read(spark)
    store.upsert(frame([(1, "b")], SCHEMA))
    assert rows(reader) == [(1, "a")] and rows(store.read(spark)) == [(1, "b")]


def test_missing_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        KeyedStore(str(tmp_path / "none"), ("k",)).read(spark)


def test_digests_find_one_changed_cell(spark, frame):
    a = frame([(i, "x") for i in range(3000)] + [(5, "x"), (None, None)], SCHEMA)
    assert dg.compared_by_digests(a, a.orderBy("v"), ["k"]).first().asDict() == {"missing": 0, "unexpected": 0, "differs": False}
    b = a.withColumn("v", F.when(F.col("k") == 1234, "y").otherwise(F.col("v")))
    found = dg.rows_that_differ(a, b, ["k"])
    assert rows(found) == [(1234, "x", "missing"), (1234, "y", "unexpected")]
    once = frame([(i, "x") for i in range(3000)] + [(None, None)], SCHEMA)
    assert rows(dg.rows_that_differ(a, once, ["k"])) == [(5, "x", "missing")]
    assert rows(dg.rows_that_differ(frame([], SCHEMA), frame([], SCHEMA), ["k"])) == []
    assert len(rows(dg.rows_that_differ(frame([(1, "a")], SCHEMA), frame([], SCHEMA), ["k"]))) == 1


def test_equal_trees_end_the_work(spark, frame):
    a = frame([(i, "x") for i in range(500)], SCHEMA)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(v):
        read.add(1)
        return v
    tree = dg.digest_tree(a, ["k"])
    watched = a.select("k", told("v").alias("v"))
    assert dg.rows_that_differ(watched, watched, ["k"], (tree, tree)).count() == 0 and read.value == 0


def test_root_is_the_sum_of_the_leaves(spark, frame):
    tree = dg.digest_tree(frame([(i, "x") for i in range(300)], SCHEMA), ["k"], bits=8, step=4)
    sums = {r["level"]: (r["rows"], r["low"]) for r in tree.groupBy("level").agg(F.sum("rows").alias("rows"), F.sum("low").alias("low")).collect()}
    assert set(sums) == {0, 4, 8} and len(set(sums.values())) == 1 and sums[0][0] == 300


def test_bucketed_panel_needs_no_exchange(spark, frame, tmp_path):
    panel = frame([(i % 11, i // 11, float(i)) for i in range(330)], "symbol long, date int, close double")
    table = stores.write_bucketed_panel(panel, "bucketed_panel_test", str(tmp_path / "b"), 4)
    w = Window.partitionBy("symbol").orderBy("date")
    out = table.withColumn("before", F.lag("close").over(w)).groupBy("symbol").agg(F.count("before").alias("n"))
    other = stores.write_bucketed_panel(panel, "bucketed_panel_test_2", str(tmp_path / "c"), 4).withColumnRenamed("close", "c2")
    joined = table.hint("merge").join(other, ["symbol", "date"])
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for df, rows_out in ((out, 11), (joined, 330)):
        assert len(df.collect()) == rows_out
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert {r["n"] for r in out.collect()} == {29}
    spark.sql("DROP TABLE bucketed_panel_test")
    spark.sql("DROP TABLE bucketed_panel_test_2")
