"""Exact linking of documents whose sketches share a band.

``rows`` has doc_id, n (set size), set_key and bands. Equal sets are one class, named by its smallest doc_id. Classes
that share a band key are candidates; every link is confirmed on the full sets. No bucket's pairs are listed at large:

1. The popularity of a class is the size of all its buckets together; the original of many copies has the highest.
   Every class is measured against one hub, the most popular class of its buckets.
2. Buckets are dealt anew into small random groups, and members of different trees are measured against one of each.
3. Buckets whose members are all in one tree by then are done. In the others, the members outside the bucket's most
   frequent tree are measured against the members of other trees, which covers every pair not yet known to be joined.
   A shingle that no other class of these buckets has is in no intersection. The others are counted in 128 parts of the
   hash space; two classes have in each part at most the smaller count in common, and pairs for which the sum is too
   little are left out, exactly. This holds off the many far copies of one original, which differ from each other.

Sizes that rule out the similarity are skipped. Tables are written before joins that may be skewed, so that both
sides are exchanged and adaptive execution can split a hot bucket, class or hub.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import keep

#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Parts of the hash space in which shared elements are counted.
PARTS = 128

Sets = Callable[[DataFrame], DataFrame]


def roots_of(parents: DataFrame) -> DataFrame:
    """(id, root) from a forest (id, parent) with one parent per id, by pointer jumping."""
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
        step = keep(parents.join(up, "parent", "left").select("id", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")))
        parents = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): root is the smallest id reachable.

    Each round hooks every root to its smallest neighbour, flattens the trees and keeps only edges between different
    roots, so the roots at least halve.
    """
    labels, edges = None, keep(edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).filter("a <> b").distinct())
    while not edges.isEmpty():
        hooked = roots_of(keep(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))))
        if labels is None:
            labels = hooked
        else:
            on = hooked.select(F.col("id").alias("root"), F.col("root").alias("_to"))
            known = labels.join(on, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
            labels = keep(known.unionByName(hooked.join(labels.select("id"), "id", "left_anti")))
        for side in ("a", "b"):
            on = hooked.select(F.col("id").alias(side), F.col("root").alias("_to"))
            edges = edges.join(on, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        edges = keep(edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).filter("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if labels is None else labels


def measured(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs (a, b) with the size of intersection and union of their full sets, and whether that links them."""
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    full = keep(sets(ids))
    other = full.select(F.col("doc_id").alias("a"), F.col("set").alias("_a"))
    # Written before the aggregate, which would else hold the join to whole hubs.
    both = keep(pairs.join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("_b")), "b").join(other, "a")
                .select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("common"), (F.size("_a") + F.size("_b")).alias("_n")))
    union = F.col("_n") - F.col("common")
    one = both.select("a", "b", "common", union.alias("union"), (100 * F.col("common") >= PERCENT * union).alias("linked"))
    return keep(one.groupBy("a", "b").agg(F.max("common").alias("common"), F.min("union").alias("union"), F.max("linked").alias("linked")))


def _sizes_fit(n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rooted(df: DataFrame, labels: DataFrame) -> DataFrame:
    """With the root of every id; an id without a label is its own root."""
    return df.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between ids."""
    for side in ("a", "b"):
        links = _rooted(links.withColumnRenamed(side, "id"), labels).drop("id").withColumnRenamed("root", side)
    joined = keep(components(links.select("a", "b")))
    on = joined.select(F.col("id").alias("root"), F.col("root").alias("_to"))
    old = labels.join(on, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    return keep(old.unionByName(joined.join(labels.select("id"), "id", "left_anti")))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with root and major (the most frequent root) of the buckets that hold more than one root."""
    rooted = keep(_rooted(members, labels))
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c"))
    mixed = keep(shares.groupBy("key").agg(F.max_by("root", F.struct("_c", "root")).alias("major"), F.count(F.lit(1)).alias("_r"))
                 .filter("_r > 1").drop("_r"))
    return keep(rooted.join(mixed, "key"))


def _shared_parts(full: DataFrame) -> DataFrame:
    """id, s and parts: how many elements of each set (doc_id, set) are in some other set too, in all and by part."""
    cells = keep(full.select(F.col("doc_id").alias("id"), F.explode("set").alias("e")))
    lone = cells.groupBy("e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_c")).filter("_c = 1")
    part = F.pmod("e", F.lit(PARTS)).cast("int").alias("part")
    counts = (cells.select("id", part, F.lit(1).alias("n")).unionByName(lone.select("id", part, F.lit(-1).alias("n")))
              .groupBy("id", "part").agg(F.sum("n").cast("int").alias("n")))
    held = counts.groupBy("id").agg(F.sum("n").alias("s"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("_m"))
    return keep(held.select("id", "s", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0))).alias("parts")))


def link(rows: DataFrame, sets: Sets) -> DataFrame:
    """(set_key, component_id) of every set of ``rows`` that is not empty.

    ``sets(ids)`` gives (doc_id, set) for a table of doc_ids. Rows with one doc_id and several texts count as one
    document that has all of them.
    """
    classes = keep(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min_by("bands", "doc_id").alias("bands")))
    spread = classes.select(F.explode("bands").alias("key"), "id", "n")
    buckets = keep(spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = keep(spread.join(buckets, "key"))

    popular = keep(members.groupBy("id").agg(F.sum("size").alias("_p"), F.max("n").alias("n")))
    ranked = members.join(popular.select("id", "_p"), "id")
    hubs = keep(ranked.groupBy("key").agg(F.max(F.struct("_p", (-F.col("id")).alias("_o"), "n")).alias("hub")))
    tried = (members.join(hubs, "key").filter((-F.col("hub._o") != F.col("id")) & _sizes_fit("n", "hub.n"))
             .groupBy(F.col("id").alias("b")).agg((-F.max("hub")["_o"]).alias("a")))
    first = measured(keep(tried), sets)
    labels = keep(components(first.filter("linked")))
    told = first.select(*_ordered("a", "b"))

    inside = _mixed(members, labels).withColumn("_g", F.pmod(F.xxhash64("id", "key"), F.greatest(F.lit(1), F.floor(F.col("size") / 4))))
    groups = keep(inside.groupBy("key", "_g").agg(F.min(F.struct("id", "n", "root")).alias("lead")))
    some = (inside.join(groups, ["key", "_g"]).filter((F.col("root") != F.col("lead.root")) & _sizes_fit("n", "lead.n"))
            .select("id", F.col("lead.id").alias("_l")).select(*_ordered("id", "_l")).distinct())
    second = measured(keep(some.join(told, ["a", "b"], "left_anti")), sets)
    labels = _merged(labels, second.filter("linked"))
    told = told.unionByName(second.select("a", "b"))

    inside = _mixed(members, labels)
    full = sets(keep(inside.select(F.col("id").alias("doc_id")).distinct()))
    inside = keep(inside.join(_shared_parts(full), "id").filter(100 * F.col("s") >= PERCENT * F.col("n")))
    names = ["id", "n", "root", "s", "parts"]
    x = inside.filter("root <> major").select("key", *[F.col(c).alias(f"x_{c}") for c in names])
    y = inside.select("key", "major", *[F.col(c).alias(f"y_{c}") for c in names])

    def enough(common: Column) -> Column:
        return 100 * common >= PERCENT * (F.col("x_n") + F.col("y_n") - common)

    by_part = F.aggregate(F.zip_with("x_parts", "y_parts", lambda a, b: F.least(a, b)), F.lit(0), lambda a, n: a + n)
    pairs = (x.join(y, "key").filter((F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("major")) | (F.col("x_id") < F.col("y_id")))
                                     & enough(F.least("x_s", "y_s")) & enough(by_part)).select(*_ordered("x_id", "y_id")).distinct())
    last = measured(keep(pairs.join(told, ["a", "b"], "left_anti")), sets)
    labels = _merged(labels, last.filter("linked"))
    return keep(_rooted(classes.select("set_key", "id"), labels).select("set_key", F.col("root").alias("component_id")))
