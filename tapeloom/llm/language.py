"""Language identification by mixture inference over byte n-grams.

Every language has a smoothed distribution over hashed byte trigrams, counted over all labelled documents. A document
is taken for a mixture of languages: expectation-maximisation estimates the proportions from the trigram likelihoods,
for the full set of languages and for the nested sets of the most likely one, two, three... of every size, and the set with the
least penalised negative likelihood (a BIC with an effective sample size, since trigrams overlap) is chosen.

Cases: a null text or one without a letter is ``und`` with score 0; rows without a language, or with a null doc_id,
teach nothing; with no labelled rows at all everything is ``und``. Repeated rows are judged alike. Other columns are
passed over. Letters are lower-cased by Unicode rules; everything that is not a letter counts as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import chunks, column, documents, id_crc, joined_bytes, short_batches, texts_of
from tapeloom.llm.suite import query

#: Hash buckets of a trigram.
BUCKETS = 4096
UNKNOWN = "und"
#: ASCII that is no letter reads as a blank.
_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Trigram bucket counts of each text (texts x BUCKETS)."""
    data, starts = joined_bytes(["  " + t.lower() for t in texts], b"  ")
    b = np.frombuffer(data.translate(_BLANK), np.uint8)
    if len(b) < 3:
        return np.zeros((len(texts), BUCKETS), np.float32)
    x = b.astype(np.uint32)
    blank = b == 32
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    use = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))[:-2]
    flat = np.bincount((row * BUCKETS + bucket)[use], minlength=len(texts) * BUCKETS)
    return flat.reshape(len(texts), BUCKETS).astype(np.float32)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities (languages x BUCKETS), counted over every labelled row.

    What reaches the driver is one number per language and bucket.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in chunks(batches):
            langs = batch.column("lang").to_pylist()
            got = trigram_counts(texts_of(batch.column("text")))
            for name in set(langs):
                mine = got[[i for i, x in enumerate(langs) if x == name]].sum(axis=0, dtype=np.float64)
                seen[name] = seen[name] + mine if name in seen else mine
        for name, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": at.astype(np.int32), "n": total[at].astype(np.int64)})

    rows = (short_batches(docs).select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
            .mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(rows["lang"].unique())
    table = np.full((len(names), BUCKETS), 0.5)
    if names:
        np.add.at(table, (np.searchsorted(names, rows["lang"]), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def mixtures(counts: np.ndarray, logp: np.ndarray, rounds: int, most: int | None, penalty: float) -> np.ndarray:
    """Proportions (texts x languages) of the chosen language set of each text, of at most ``most`` languages or all of them."""
    p = np.exp(logp - logp.max(axis=0, keepdims=True)).astype(np.float32)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    shift = counts @ logp.max(axis=0).astype(np.float32)

    def em(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = start
        for _ in range(rounds):
            pi = pi * ((counts / np.maximum(pi @ p, 1e-30)) @ p.T) / total
        return pi, (counts * np.log(np.maximum(pi @ p, 1e-30))).sum(axis=1) + shift

    full, like = em(np.full((len(counts), len(p)), 1 / len(p), np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    effective = np.maximum(total[:, 0] / 3, 2)
    best, cost = full, -like + penalty * len(p) * np.log(effective)
    for k in range(len(p) - 1 if most is None else min(most, len(p) - 1), 0, -1):
        mask = (rank < k).astype(np.float32)
        pi, like = (mask, counts @ logp.astype(np.float32).T) if k == 1 else em(mask / k)
        like = (like * mask).sum(axis=1) if k == 1 else like
        this = -like + penalty * k * np.log(effective)
        take = this <= cost
        best, cost = np.where(take[:, None], pi, best), np.where(take, this, cost)
    return best


def identify(docs: DataFrame, names: list[str], logp: np.ndarray, rounds: int = 8, most: int | None = None, penalty: float = 4.0,
             text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` with lang_pred (largest proportion of the chosen set), score (that proportion) and langs (the set).

    ``text`` may be a field of a struct among the keys ("row.text"), which then is not sent twice.
    """
    inside = text.partition(".")[0] in keys
    given, path = short_batches(docs.select(*keys) if inside else docs.select(*keys, F.col(text).alias("_text"))), text if inside else "_text"
    schema = T.StructType([*docs.select(*keys).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("langs", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, path):
            texts = texts_of(column(batch, path))
            preds, scores, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts)
            lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if names else []
            for at in range(0, len(lettered), 256):
                some = lettered[at:at + 256]
                pi = mixtures(trigram_counts([texts[i] for i in some]), logp, rounds, most, penalty)
                for i, row in zip(some, pi, strict=True):
                    top = int(row.argmax())
                    preds[i], scores[i] = names[top], min(1.0, float(row[top]))
                    sets[i] = ",".join(f"{names[j]}:{row[j]:.2f}" for j in np.argsort(-row, kind="stable") if row[j] >= 0.01)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(preds), pa.array(scores), pa.array(sets)],
                                             names=[*keys, "lang_pred", "score", "langs"])

    return given.mapInArrow(judge, schema)


def teaching(docs: DataFrame) -> DataFrame:
    """The rows that may teach: crc32 of the id mod 3 is not 1."""
    return docs.filter(id_crc(F.col("doc_id")) % 3 != 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_crc(doc_id) % 3 == 1, F.lit(False))


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    names, logp = fit(teaching(docs))
    return identify(docs, names, logp).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows in which one learned language holds at least ``least`` of the text; ``und`` rows go. Columns stay as they are."""
    names, logp = fit(teaching(docs))
    judged = identify(docs.select(F.struct("*").alias("_row")), names, logp, keys=("_row",), text="_row.text")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
