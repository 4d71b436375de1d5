"""Column and file helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import ensure_checkpoint_dir

#: Words are runs without these six characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task turns into arrays at once.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever the names hold."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def keep(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared checkpoint folder and go on from the files.

    Readers prune columns, and a lost executor costs no lineage. The files stay on disk beside the shuffles of later
    stages, and most of them are texts, so they are packed with zstd.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null becomes the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def short_batches(df: DataFrame, most: int = 1000) -> DataFrame:
    """The frame, after limiting the rows that its session hands to Python at once: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= most:
        df.sparkSession.conf.set(name, str(most))
    return df


def column(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or with a dotted path a field of a struct column."""
    name, _, inner = path.partition(".")
    return batch.column(name).field(inner) if inner else batch.column(name)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about ``most`` bytes; a longer text is a batch of its own."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column(batch, text)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def joined_bytes(texts: list[str], sep: bytes = b" ") -> tuple[bytes, np.ndarray]:
    """UTF-8 of all texts, each followed by ``sep``, and the offsets at which each starts (one more at the end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + len(sep) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    return sep.join(parts) + (sep if parts else b""), np.concatenate([[0], ends]).astype(np.int64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
