"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is a bag of subwords: itself and its byte n-grams of 3 to 5 with its borders, hashed into buckets. A stretch of
32 words is the average of its subwords' embeddings (a short one padded with zeros), and a linear softmax gives its probability of label 1; a document
has the score of its most toxic stretch, so a long document is not diluted. Embeddings and softmax are trained together
by Adagrad on labelled documents: a toxic document teaches by its currently most toxic stretch (at first by random
ones), a clean one by its most toxic stretch and random ones. A misspelt word shares n-grams with the words it was
made from, and so their vectors.

After training, the softmax of an average is an average of one number per bucket, which is all that tasks need.

Training uses at most ``most`` documents of each label, the smallest by a hash of the id. Labels, language, source and
doc_id are never inputs of a score. Cases: null texts and texts without a letter score 0; null labels teach nothing,
and a document that is labelled twice counts as toxic if one label says so; without toxic or without clean labels
every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import chunks, documents, id_crc, joined_bytes, mix, short_batches, texts_of
from tapeloom.llm.shingles import powers
from tapeloom.llm.suite import query

#: Hash buckets (power of two), words of a stretch, n-gram lengths, embedding width, subwords to which a stretch is padded.
BITS, STRETCH, GRAMS, WIDTH, LEAST = 17, 32, (3, 4, 5), 8, 256
#: ASCII that is no letter separates words.
_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and stretch of every subword of all texts, and the first stretch of each text (one more at the end)."""
    data, starts = joined_bytes([" " + t.lower() for t in texts])
    b = np.frombuffer(data.translate(_BLANK), np.uint8)
    blank = b == 32
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    word = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    word_at = np.searchsorted(first, starts)
    counts = np.diff(word_at)
    stretch_at = np.concatenate([[0], np.cumsum(-(-counts // STRETCH))])
    text = np.repeat(np.arange(len(texts)), counts)
    stretch = stretch_at[text] + (np.arange(len(first)) - word_at[text]) // STRETCH
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])])
    buckets, owners = [], []
    for n in GRAMS:
        inner = ~blank[1:len(b) - n + 2]
        for k in range(2, n - 1):
            inner = inner & ~blank[k:len(b) - n + 1 + k]
        at = np.flatnonzero(inner[:max(0, len(b) - n + 1)])
        buckets.append(mix((total[at + n] - total[at]) * down[at], n))
        owners.append(stretch[word[at + 1]])
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    buckets.append(mix((total[end] - total[first]) * down[first], 99))
    owners.append(stretch)
    return (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owners).astype(np.int32), stretch_at


@dataclass
class Scorer:
    """One number per bucket and a bias: the softmax's difference of the two labels."""

    values: np.ndarray
    bias: float

    def stretches(self, buckets: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
        """Difference of the two labels' logits for each stretch."""
        n = np.bincount(owners, minlength=count)
        return np.bincount(owners, weights=self.values[buckets], minlength=count) / np.maximum(n, LEAST) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, owners, at = subwords(texts)
        logits = self.stretches(buckets, owners, int(at[-1]))
        some = np.flatnonzero(np.diff(at))
        out = np.zeros(len(texts))
        if len(some):
            out[some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logits, at[:-1][some]), -500, 500)))
        return out


def train(texts: list[str], labels: np.ndarray, rounds: int = 10, warm: int = 4, rate: float = 0.2, toxic_share: float = 0.3, batch: int = 256, seed: int = 1) -> Scorer:
    """Joint training of embeddings and softmax on whole texts."""
    labels = np.asarray(labels, np.int64)
    nothing = Scorer(np.zeros(1 << BITS, np.float32), -1e9)
    if not len(labels) or labels.min() == labels.max():
        return nothing
    buckets, lengths, ats = [], [], []
    for i in range(0, len(texts), 128):
        got, owners, first = subwords(texts[i:i + 128])
        buckets.append(got[np.argsort(owners, kind="stable")])
        lengths.append(np.bincount(owners, minlength=int(first[-1])))
        ats.append(np.diff(first))
    buckets = np.concatenate(buckets)
    begin = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    at = np.concatenate([[0], np.cumsum(np.concatenate(ats))])
    sizes = np.diff(at)
    some = np.flatnonzero(sizes)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (2, WIDTH)), np.zeros(2)
    steps = [np.full_like(embed, 1e-8), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)]

    def collapsed() -> Scorer:
        return Scorer((embed @ (soft[1] - soft[0]).astype(np.float32)).astype(np.float32), float(bias[1] - bias[0]))

    for turn in range(rounds):
        random = [at[some] + (rng.random(len(some)) * sizes[some]).astype(np.int64) for _ in range(3)]
        if turn < warm:
            picked, target = np.concatenate(random), np.tile(labels[some], 3)
        else:
            scorer, logits = collapsed(), np.empty(len(begin) - 1)
            for a in range(0, len(logits), 4096):
                ends = begin[a:a + 4097]
                own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                logits[a:a + 4096] = scorer.stretches(buckets[ends[0]:ends[-1]], own, len(ends) - 1)
            peak = np.maximum.reduceat(logits, at[:-1][some])
            doc = np.repeat(some, sizes[some])
            top = np.flatnonzero(logits == peak[np.searchsorted(some, doc)])
            top = top[np.unique(doc[top], return_index=True)[1]]
            clean = labels[some] == 0
            picked = np.concatenate([top, *(r[clean] for r in random[:2])])
            target = np.concatenate([labels[some], np.zeros(2 * int(clean.sum()), np.int64)])
        weight = np.where(target == 1, toxic_share / max(1, target.sum()), (1 - toxic_share) / max(1, (1 - target).sum())) * len(target)
        for some_of in np.array_split(rng.permutation(len(picked)), max(1, len(picked) // batch)):
            s, y, w = picked[some_of], target[some_of], weight[some_of]
            n = begin[s + 1] - begin[s]
            row = np.repeat(np.arange(len(s)), n)
            grams = buckets[begin[s][row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row])]
            mean = np.add.reduceat(embed[grams], np.cumsum(n) - n, axis=0) / np.maximum(n, LEAST)[:, None]
            z = mean @ soft.T + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            wrong = (z / z.sum(axis=1, keepdims=True) - np.eye(2)[y]) * w[:, None] / len(s)
            back = (wrong @ soft / np.maximum(n, LEAST)[:, None]).astype(np.float32)
            slope = np.stack([np.bincount(grams, weights=back[row, k], minlength=1 << BITS) for k in range(WIDTH)], axis=1).astype(np.float32)
            for value, grad, seen in ((embed, slope, steps[0]), (soft, wrong.T @ mean, steps[1]), (bias, wrong.sum(axis=0), steps[2])):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
    return collapsed()


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` documents of each label; the ids sent to the tasks are bounded alike."""
    said = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    said = said.filter(id_crc(F.col("doc_id")) % 5 != 0)
    ids = [said.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", "text", "toxic").toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable").drop_duplicates("doc_id")
    return rows["text"].tolist(), rows["toxic"].to_numpy()


def score(docs: DataFrame, scorer: Scorer, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, score and predicted of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = T.StructType([*docs.select(*keys).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            got = shipped.value.scores(texts_of(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=schema.names)

    return short_batches(docs).select(*keys, F.col(text).alias("_text")).mapInArrow(work, schema)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str, most: int = 2000) -> DataFrame:
    docs = documents(spark, sf_dir)
    scorer = train(*labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), most))
    out = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return score(docs, scorer).withColumn("held_out", out).select("doc_id", "held_out", "score", "predicted")
