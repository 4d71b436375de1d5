"""Near-duplicate removal by fast similarity sketching.

A document is the set of its distinct five-word shingles, A-Z lower-cased, as 64-bit hashes; with fewer words the whole
sequence is its one shingle. Sketches of 128 coordinates are cut into 32 bands of 4 (a pair at the similarity of 0.75
shares no band with probability 5e-6); documents that share a band are confirmed on their full sets and linked when
100 * intersection >= 75 * union.

Cases: null, empty and blank texts have no set and are linked with nothing; rows with a null doc_id are linked with
nothing, have a null component and are kept; repeated rows share a component, and both are kept if their doc_id names
it; an empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import chunks, documents, keep, quoted, short_batches, texts_of
from tapeloom.llm.links import link
from tapeloom.llm.shingles import band_keys, fast_similarity_sketch, set_keys, shingle_sets
from tapeloom.llm.suite import query

#: Coordinates of a band.
BAND_ROWS = 4


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_key, bands) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, offsets = shingle_sets(texts_of(batch.column("text")))
            bands = band_keys(fast_similarity_sketch(flat, offsets), BAND_ROWS)
            lists = pa.ListArray.from_arrays(pa.array(range(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(offsets[1:] - offsets[:-1]), pa.array(set_keys(flat, offsets), pa.binary()), lists],
                                             names=["doc_id", "n", "set_key", "bands"])

    given = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(work, "doc_id long, n long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, set) of the rows with one of ``ids``, which are distinct."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, offsets = shingle_sets(texts_of(batch.column("text")))
            sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view("int64")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["doc_id", "set"])

    given = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return given.mapInArrow(work, "doc_id long, set array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return judged(docs, keep(sketches(docs)))


def judged(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The same from the sketches of ``docs``, which are written."""
    found = link(rows, lambda ids: full_sets(docs, ids))
    out = rows.select("doc_id", "n", "set_key").join(found, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
"""
ORACLE = ORACLE.replace("WITH w", "WITH RECURSIVE w", 1) + r"""
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT g.b, r.c FROM reach r JOIN g ON g.a = r.doc_id AND r.c < g.b),
c AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""


@query("op6_neardup", ORACLE)
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, columns as they are. Rows that repeat a doc_id are judged each by its own text."""
    rows = keep(sketches(docs))
    again = keep(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c"), (F.min("set_key") < F.max("set_key")).alias("_differ")).filter("_c > 1"))
    if not again.filter("_differ").isEmpty():
        return _one_of_each_row(docs)
    gone = keep(judged(docs, rows).filter("NOT kept").select("doc_id").distinct())
    out = docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
    again = again.select("doc_id")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").select(*quoted(docs.columns)).unionByName(
        out.join(again, "doc_id", "left_semi").select(*quoted(docs.columns)).dropDuplicates(["doc_id"]))


def _one_of_each_row(docs: DataFrame) -> DataFrame:
    """One row of each group where a doc_id has several texts: rows are written with numbers that stand for the ids in the linking."""
    own = keep(docs.select(F.struct("*").alias("_row")).withColumn("_no", F.monotonically_increasing_id()))
    named = own.filter("_row.doc_id IS NOT NULL")
    found = near_duplicates(named.select(F.col("_no").alias("doc_id"), "_row.text")).select(F.col("doc_id").alias("_no"), "n_shingles", "component_id")
    with_ids = keep(found.join(named.select("_no", F.col("_row.doc_id").alias("_id")), "_no"))
    # the smallest id of a component stays, and of texts without shingles each id once
    group = [F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_component"), F.when(F.col("n_shingles") == 0, F.col("_id")).alias("_alone")]
    stays = with_ids.groupBy(*group).agg(F.min(F.struct("_id", "_no")).alias("_first")).select("_first._no")
    gone = keep(with_ids.select("_no").join(stays, "_no", "left_anti"))
    return own.join(gone, "_no", "left_anti").select("_row.*")
