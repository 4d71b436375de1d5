"""Range-ordered helpers against pandas on skewed groups and heavy ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.plans import ordered
from tapeloom.plans.components import connected_components


def skewed(spark, n=6000, seed=1):
    """A third of all rows in one group, a third of all values equal."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    v = np.where(rng.random(n) < 1 / 3, 1.5, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"g": g.astype("int64"), "v": v, "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf)


def test_row_numbers_match_a_full_sort(spark):
    pdf, df = skewed(spark)
    got = ordered.row_numbers(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).toPandas().set_index("id")
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    want = want.set_index("id")
    assert (got["rank"].sort_index() == want["rank"].sort_index()).all()
    assert (got["size"] == got["g"].map(pdf.groupby("g").size())).all()


def test_the_hot_group_is_spread_over_several_partitions(spark):
    _, df = skewed(spark)
    laid = ordered.lay_out(df, ["g"], [F.col("v"), F.col("id")])
    parts = laid.filter("g = 0").select(ordered.PART).distinct().count()
    assert parts >= 2 or laid.select(ordered.PART).distinct().count() == 1


def test_average_ranks_match_pandas(spark):
    pdf, df = skewed(spark)
    got = ordered.average_ranks(df, ["g"], "v", "r", "n").toPandas().set_index("id").sort_index()
    want = pdf.set_index("id").groupby("g")["v"].rank()
    assert np.allclose(got["r"], want.sort_index())


def test_quantiles_match_pandas(spark):
    pdf, df = skewed(spark)
    got = ordered.quantiles(df, ["g"], "v", {"q25": 0.25, "med": 0.5}).toPandas().set_index("g").sort_index()
    assert np.allclose(got["med"], pdf.groupby("g")["v"].median())
    assert np.allclose(got["q25"], pdf.groupby("g")["v"].quantile(0.25))


def test_running_sums_match_pandas(spark):
    pdf, df = skewed(spark)
    got = ordered.running_sums(df, ["g"], [F.col("id")], {"s": F.col("v")}).toPandas().set_index("id").sort_index()
    assert np.allclose(got["s"], pdf.sort_values("id").groupby("g")["v"].cumsum())


def test_long_chain_is_one_component(spark):
    edges = [(f"I{i:03d}", f"S{i}") for i in range(60)] + [(f"I{i + 1:03d}", f"S{i}") for i in range(60)] + [("X", "Y")]
    labels = connected_components(spark.createDataFrame(edges, "isin string, node string"), "isin", "node").collect()
    assert {r["label"] for r in labels if r["isin"] != "X"} == {"I000"}
    assert [r["label"] for r in labels if r["isin"] == "X"] == ["X"]
