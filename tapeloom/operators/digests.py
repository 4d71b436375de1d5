"""Comparison of two tables by trees of digests, so that only key ranges that differ are compared row by row.

A row belongs to the leaf named by the top bits of its key's hash. A leaf's digest is a count and two sums of row hashes,
a node's digest the sum over its leaves; equal nodes end the descent. A tree has at most 2^bits leaves whatever the
table's size, so it can be kept beside the table and the table need not be read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import settle

BITS = 16
STEP = 8


def leaf_of(keys: Sequence[str], bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def digest_tree(df: DataFrame, keys: Sequence[str], bits: int = BITS, step: int = STEP) -> DataFrame:
    """level, node, rows, low, high: the digests of all nodes from the root (level 0) to the leaves (level ``bits``).

    One scan with partial sums; the levels above come from the leaves. The two halves of a 64-bit row hash are summed
    apart, so the sums of a leaf are exact for 2^31 rows and repeated rows do not cancel.
    """
    h = F.xxhash64(*sorted(df.columns), F.lit(17))
    leaves = df.groupBy(leaf_of(keys, bits).alias("_leaf")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"))
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftrightunsigned("_leaf", bits - n).alias("node")) for n in [*range(0, bits, step), bits]])).alias("_at")
    # decimals keep the sums of the upper levels from overflowing
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("rows", "low", "high")]
    return leaves.select(levels, "rows", "low", "high").groupBy("_at.level", "_at.node").agg(*wide)


def differing_leaves(a: DataFrame, b: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """Leaves whose digests differ, found from the root down: children of equal nodes are not looked at.

    Each level's open nodes (at most 2^bits, and few unless much differs) are settled; with none left the descent ends.
    """
    open_nodes = None
    for level in [*range(0, bits, step), bits]:
        mine, yours = (t.filter(F.col("level") == level).select("node", F.struct("rows", "low", "high").alias(n)) for t, n in ((a, "_a"), (b, "_b")))
        if open_nodes is not None:
            up = F.shiftrightunsigned("node", level - last)
            mine, yours = (t.withColumn("_up", up).join(open_nodes.withColumnRenamed("node", "_up"), "_up", "left_semi").drop("_up") for t in (mine, yours))
        open_nodes = mine.join(yours, "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        open_nodes, last = settle(open_nodes), level
        if open_nodes.isEmpty():
            break
    return open_nodes.withColumnRenamed("node", "leaf")


def rows_that_differ(generated: DataFrame, stored: DataFrame, keys: Sequence[str], trees: tuple[DataFrame, DataFrame] | None = None,
                     bits: int = BITS, step: int = STEP) -> DataFrame:
    """Rows of one table that the other lacks, with ``side`` (missing: not stored; unexpected: not generated).

    ``trees`` are digest trees kept from earlier; without them each table is read once for its tree. The rows of
    differing leaves alone are then compared as multisets, and nothing more is read when the trees agree. There are at most 2^bits leaves, which bounds the
    broadcast.
    """
    stored = stored.select(*generated.columns)
    first, second = trees or (settle(digest_tree(generated, keys, bits, step)), settle(digest_tree(stored, keys, bits, step)))
    leaves = differing_leaves(first, second, bits, step)
    if leaves.isEmpty():
        return generated.sparkSession.createDataFrame([], T.StructType([*generated.schema.fields, T.StructField("side", T.StringType())]))
    mine, yours = (t.withColumn("leaf", leaf_of(keys, bits)).join(F.broadcast(leaves), "leaf", "left_semi").drop("leaf") for t in (generated, stored))
    return (mine.exceptAll(yours).withColumn("side", F.lit("missing"))
            .unionByName(yours.exceptAll(mine).withColumn("side", F.lit("unexpected"))))


def compared_by_digests(generated: DataFrame, stored: DataFrame, keys: Sequence[str], trees: tuple[DataFrame, DataFrame] | None = None, bits: int = BITS) -> DataFrame:
    """One row: counts of missing and unexpected rows and whether the tables differ."""
    found = rows_that_differ(generated, stored, keys, trees, bits)
    return found.agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "unexpected").alias("unexpected")) \
        .withColumn("differs", (F.col("missing") + F.col("unexpected")) > 0)
