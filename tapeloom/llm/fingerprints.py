"""Document fingerprints by MinHash.

A fingerprint is 128 universal hash minima over the distinct five-word shingles of a text (A-Z lower-cased; with fewer
words the whole sequence is one shingle), of which the low 16 bits each are written in hexadecimal. The share of equal
places estimates the Jaccard similarity of two texts with a standard error of at most 0.045. For finding near copies
the signatures are cut into 32 bands of 4, the bands are joined in Spark, and links are confirmed on the full sets.

The edited text of a document takes the beginning of the next one, so documents are laid out in ranges of doc_id, each
with a copy of the next range's first row; the ranges are cut at sampled ids, and every text is shuffled once.

Cases: null counts as empty; texts without words share one fingerprint and are as like each other as can be; repeated
ids follow each other in text order; rows with a null doc_id come last; a single row is its own next; an empty table
gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import chunks, documents, keep, short_batches, texts_of
from tapeloom.llm.links import link
from tapeloom.llm.neardup import full_sets
from tapeloom.llm.shingles import band_keys, minhash_signatures, set_keys, shingle_sets
from tapeloom.llm.suite import query

#: Hash functions of a signature and coordinates of a band.
HASHES, BAND_ROWS = 128, 4
#: Bytes of text in a range of doc_id; ranges, their first ids and cut points are what the driver sees.
RANGE_BYTES = 16 << 20


def signatures(texts: list[str]) -> np.ndarray:
    """16 bits of each minimum (texts x HASHES)."""
    return (minhash_signatures(*shingle_sets(texts), HASHES) & np.uint32(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and the fingerprint of every row."""
    schema = T.StructType([*docs.select(*keys).schema.fields, T.StructField("fingerprint", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            found = signatures(texts_of(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([row.tobytes().hex() for row in found], pa.string())], names=schema.names)

    return short_batches(docs).select(*keys, F.col(text).alias("_text")).mapInArrow(work, schema)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id: the smallest doc_id linked with it, over confirmed links of documents that share a band."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat, offsets = shingle_sets(texts_of(batch.column("text")))
            bands = band_keys(minhash_signatures(flat, offsets, HASHES), BAND_ROWS)
            lists = pa.ListArray.from_arrays(pa.array(range(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(offsets[1:] - offsets[:-1]), pa.array(set_keys(flat, offsets), pa.binary()), lists],
                                             names=["doc_id", "n", "set_key", "bands"])

    rows = keep(short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, set_key binary, bands array<long>"))
    return (rows.join(link(rows, lambda ids: full_sets(docs, ids)), "set_key", "left")
            .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def laid_out(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, _range and _guest: rows in ranges of doc_id, each range followed by the first row of the next one
    as a guest (after the last range: of the first). Cut points and first ids are all that the driver sees."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = np.unique(np.array(rows.approxQuantile("doc_id", shares, 1 / (4 * ranges)), np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.fillna(0).astype("int64"), side="right")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, at))

    firsts = {r[0]: r[1] for r in rows.select("doc_id", range_of("doc_id").alias("_range")).groupBy("_range").agg(F.min("doc_id")).collect()}
    order = sorted(firsts)
    home = docs.sparkSession.createDataFrame([(firsts[r], order[i - 1]) for i, r in enumerate(order)], "_first long, _range int")
    guests = rows.join(F.broadcast(home), F.col("doc_id").eqNullSafe(F.col("_first"))).groupBy("doc_id", "_range").agg(F.min("text").alias("text"))
    everyone = (rows.withColumn("_range", range_of("doc_id")).withColumn("_guest", F.lit(False))
                .unionByName(guests.withColumn("_guest", F.lit(True))))
    return everyone.repartitionById(len(cuts) + 2, F.col("_range")).sortWithinPartitions("_range", "_guest", F.col("doc_id").asc_nulls_last(), "text")


def edited_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every row and of its edited text, and the likeness to the edited text and to the next row's.

    The edited text has its last half replaced by as much of the next row's beginning.
    """
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
        ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    laid = laid_out(docs, ranges)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple[int | None, str, bool]] = []
        for batch in chunks(batches):
            rows = left + list(zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("_guest").to_pylist(), strict=True))
            left = [] if rows[-1][2] else rows[-1:]
            texts = [t for _, t, _ in rows]
            own = [k for k in range(len(rows) - 1) if not rows[k][2]]
            if not own:
                continue
            edited = [texts[k][:len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][:len(texts[k]) // 2] for k in own]
            prints, changed = signatures(texts), signatures(edited)
            mine = prints[own]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([rows[k][0] for k in own], pa.int64()), "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                "fingerprint": [row.tobytes().hex() for row in mine], "edited_fingerprint": [row.tobytes().hex() for row in changed],
                "near_edited": likeness(mine, changed), "near_next": likeness(mine, prints[[k + 1 for k in own]])})

    return short_batches(laid).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
