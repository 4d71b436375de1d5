"""From documents to a mixed, encoded training corpus: five stages, each written as Parquet and read again.

1. ``language``: rows whose text is in no learned language, or mostly in none, go.
2. ``quality``: rows that the base rules or the divergence from every language reference reject go.
3. ``near_duplicates``: one document of each group of near copies stays.
4. ``mixture``: documents are repeated or left out so that sources meet their target weights.
5. ``encode``: the rows' texts as piece ids.

The stages decide about whole rows, and all but the last return the columns of ``documents``. Empty inputs give empty
results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import language, mixture, neardup, pieces, quality
from tapeloom.llm.common import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.materialise(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.model_bytes(), keys=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("encode", encode_stage),
]

#: Two stages are trained models and a transducer, which SQL does not express. Tests compare the rows of near_duplicates and of
#: mixture with what small tables call for; whole runs are compared by row counts and columns only, not with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs)
    return docs
